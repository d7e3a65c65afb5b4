"""What holds at any size: splits, blocks and ranges make no difference, and nothing whole is gathered."""

import csv
import hashlib
import io
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crossfade.functions import features as X
from crossfade.functions.text import _fold_steps, fold_ascii
from crossfade.operators import durations as D
from crossfade.operators import match as M
from crossfade.operators import merge as G
from crossfade.operators import metrics as K
from crossfade.operators.places import numbered
from crossfade.plans import queries as Q
from crossfade.schema import DURATION_TOLERANCE_MS as TOL
from crossfade.sources import records as R
from crossfade.sources import sinks
from crossfade.sources import tables as S
from crossfade.sources.storage import Folder


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# CSV


def odd_rows(rng, n):
    cells = ["plain", "", "two\nlines", 'a "word"', "a,b", 'x"y', "\n", '"', ",", "é\U0001f600", "N/A", " pad ", "r\r\nn", "end\\", "1" * 40, 'many\n"lines"\n,of\n\n"quotes"', "l\n" * 30]
    return [[rng.choice(cells) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("size,end", [(300, "\n")])
def test_csv_in_splits_is_the_whole_file_reader(spark, tmp_path, small_splits, size, end):
    rng = random.Random(size)
    for k in range(1):
        text = io.StringIO(newline="")
        writer = csv.writer(text, lineterminator=end)
        writer.writerow(["a", 'b "q"', "c"])
        writer.writerows(odd_rows(rng, 25))
        # a quote inside a field that doesn't begin with one is text, and a blank line is no row
        text.write(f'5" disc,12" mix,x{end}{end}short{end}"q"tail,2,3{end}')
        (tmp_path / f"{k}.csv").write_text(text.getvalue(), newline="")
    small_splits(1 << 30)
    old = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', quote='"')
    old = old.select(*[F.when(~F.col(f"`{c}`").isin(*S.NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in old.columns])
    want = sorted(map(tuple, old.collect()), key=repr)
    small_splits(size)
    got = S.read_csv(spark, str(tmp_path))
    assert got.columns == old.columns
    clean = lambda rows: sorted((tuple(x.replace("\r\n", "\n") if x else x for x in r) for r in rows), key=repr)
    assert clean(map(tuple, got.collect())) == clean(want)
    if size < 1000:
        assert R._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 3


def test_places_as_read_do_not_depend_on_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for k in range(3):
        with open(tmp_path / f"part{k}.csv", "w", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(["n", "t"])
            writer.writerows([(f"{k}:{i}", rng.choice(["x", "two\nlines", "\n" * 30, 'q"'])) for i in range(20)])
    want = [f"{k}:{i}" for k in range(3) for i in range(20)]
    for size in (80,):
        small_splits(size)
        rows = S.read_csv(spark, str(tmp_path), "place").collect()
        assert [r.n for r in sorted(rows, key=lambda r: r.place)] == want and len({r.place for r in rows}) == len(rows)


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    (tmp_path / "n.csv").write_text("a,b\n1,2")
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed')
    assert S.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    assert S.read_csv(spark, str(tmp_path / "n.csv"), "ord").collect()[0].asDict() == {"a": "1", "b": "2", "ord": 4}
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "open.csv")).collect()] == [("1", "never\nclosed")]


def test_ends_inside():
    for line, outside, inside in (("", False, True), ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('x"y', False, False), ('"a""', True, False), ('","', False, True), ('"a","b', True, True), ('a""', False, True)):
        got = R.ends_inside(line, False), R.ends_inside(line, True)
        assert got == (outside, inside), line


# files


@pytest.mark.parametrize("content", [b"", b"a\nb", b"\xef\xbb\xbfx\ny", b"\xef\xbb\xbfx\n", b"\r\n\r\x00\xff\xfe\n\n" + bytes(range(256)) * 4])
def test_digests_in_splits(spark, tmp_path, small_splits, content):
    small_splits(64)
    (tmp_path / "f").write_bytes(content)
    assert sinks.sha256_file(spark, str(tmp_path / "f")) == hashlib.sha256(content).hexdigest()


def test_digests_of_a_table_hold_no_file_in_a_row(spark, tmp_path, small_splits):
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("x")).repartition(3).write.parquet(f"{tmp_path}/t")
    small_splits(4096)
    digests = Folder(spark, f"{tmp_path}/t").digests()
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in digests.collect()}
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "t").glob("part-*")}
    assert got == want and "binaryFile" not in plan(digests)


def test_ordered_csv_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(5000).repartition(7).select(F.col("id"), F.lit('a,"b"\n').alias('odd, "name"'), F.array(F.col("id")).alias("list")).orderBy("id")
    sinks.write_csv(df, str(tmp_path / "out.csv"))
    with open(tmp_path / "out.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["id", 'odd, "name"', "list"] and [r[0] for r in rows[1:]] == [str(i) for i in range(5000)] and rows[1][1:] == ['a,"b"\n', "[0]"]
    sinks.write_csv(df.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == 'id,"odd, ""name""",list\n' and sorted(p.name for p in tmp_path.iterdir()) == ["none.csv", "out.csv"]


def test_a_table_replaced_meanwhile_is_read_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    seen = []

    def query(df):
        seen.append(1)
        if len(seen) == 1:
            spark.range(7).write.mode("overwrite").parquet(path)
        return df.count()

    assert S.with_catalog(spark, path, query) == 7 and len(seen) == 2
    with pytest.raises(S.CatalogError):
        S.with_catalog(spark, path, lambda df: df.select("no such column"))


# durations


def fold(values):
    a = None
    for d in values:
        a = d if a is None else max(a, d) if abs(a - d) <= TOL else a
    return a


def test_a_lift_is_the_fold_of_any_value_before():
    rng = random.Random(3)
    for _ in range(300):
        values = [rng.choice([rng.randrange(20), rng.randrange(200)]) for _ in range(rng.randrange(0, 25))]
        lift = D.Lift(tolerance=7)
        for d in values:
            lift.then(d)
        assert lift.low == sorted(lift.low) and all(a <= b for a, b in zip(lift.low, lift.high))
        for a in range(-5, 215):
            want = a
            for d in values:
                want = max(want, d) if abs(want - d) <= 7 else want
            assert lift.of(a) == want


def test_durations_fold_in_order_over_ranges(spark):
    rng = random.Random(6)
    rows = [("hot", i, rng.randrange(60_000)) for i in range(4000)] + [(f"k{k}", i, rng.choice([None, 1000, 2500, 4000, 9000])) for k in range(200) for i in range(rng.randrange(1, 6))]
    rows += [("steps", i, 1500 * i) for i in range(500)] + [("falls", i, 1_000_000 - 1500 * i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ord long, d int")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.k: r.x for r in D.fold_in_order(df, ["k"], "ord", "d", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = {}
    for k, i, d in sorted(rows, key=lambda r: r[1]):
        own.setdefault(k, []).append(d)
    want = {k: fold([d for d in v if d is not None]) for k, v in own.items()}
    assert got == {k: v for k, v in want.items() if v is not None} and want["falls"] == own["falls"][0] and want["steps"] == own["steps"][-1]


def test_very_many_rows_of_one_entity(spark):
    """They are folded by ranges; none of them is gathered."""
    rows = spark.range(50_000).select(F.lit("x").alias("track_id"), F.lit("t").alias("name"), F.col("id").alias("ord"), (F.lit(100_000) + F.pmod(F.xxhash64("id"), F.lit(50_000))).cast("string").alias("duration_ms"), F.lit("a").alias("artist_name"))
    merged = G.merge_by_id(G.union_normalized([rows]), ranged=True)
    assert "collect_list(struct(ord" not in plan(merged)
    start = time.time()
    got = merged.first().duration_ms
    values = [100_000 + r[0] for r in spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("int"), "id").orderBy("id").collect()]
    assert got == fold(values) and time.time() - start < 120


def test_rows_are_read_once_more_only_for_keys_of_very_many_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([None, None, None, "a", "b", "c", "d"]), "t", str(rng.choice([100_000, 101_500, 103_000, 109_000])), "x", i) for i in range(60)]
    df = spark.createDataFrame(rows, "track_id string, name string, duration_ms string, artist_name string, ord long")
    merged = lambda: G.merge_by_id(G.union_normalized([df]), ranged=True)
    few = merged()
    assert "MapInArrow" not in plan(few) and plan(few).count("Scan ExistingRDD") == 1
    most = max(sum(r[0] == k for r in rows) for k in "abcd")
    monkeypatch.setattr(G, "GATHERED", most - 1)
    many = merged()
    assert "MapInArrow" in plan(many) and "collect_list(struct(ord" not in plan(many)
    durations = lambda d: sorted((r.track_id, r.duration_ms) for r in d.where("track_id is not null").collect())
    assert durations(few) == durations(many) == [(k, fold([int(r[2]) for r in rows if r[0] == k])) for k in "abcd"]
    # rows without a key are no key's rows, however many there are
    monkeypatch.setattr(G, "GATHERED", most)
    assert sum(r[0] is None for r in rows) > most and "MapInArrow" not in plan(merged())


# medians


@pytest.mark.parametrize("sketch,bound", [(100, 50)])
def test_medians_gather_a_bounded_number_of_values(spark, monkeypatch, sketch, bound):
    monkeypatch.setattr(X, "SKETCH", sketch)
    monkeypatch.setattr(X, "GATHERED", max(bound, 1))
    rng = random.Random(sketch + bound)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), None if rng.random() < 0.3 else rng.random() ** 9, None, 5.0, rng.choice([0.0, float(rng.random() > 0.5), rng.random()])) for _ in range(5001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    seen = []
    for part in (df, df.limit(2), df.limit(0)):
        part = part.persist()
        got = X.wide_medians(part, {c: c for c in "abcdef"}).first()
        want = part.agg(*[F.median(c).alias(c) for c in "abcdef"]).first()
        assert tuple(got) == tuple(want)
        seen.append(got)
        part.unpersist()


# resamples


def test_gaps_do_not_depend_on_how_many_tasks_read_the_lines(spark, tmp_path, small_splits):
    """Tracks with the same lines have the same mean, to the last digit: no gap is wider than another by the order of its sums."""
    rng = random.Random(5)
    parts, lines = 40, [(rng.randrange(9) / 100, rng.randrange(1, 51), rng.choice("RAN"), rng.choice("OF")) for _ in range(30)]
    dealt = [k for k in range(1, parts + 1) for _ in lines]
    rng.shuffle(dealt)
    given = {k: iter(lines) for k in dealt}
    rows = [(i, k, 1, *next(given[k])) for i, k in enumerate(dealt)]
    tables = {
        "part": pa.table({"p_partkey": range(1, parts + 1), "p_name": ["n"] * parts, "p_brand": ["b"] * parts, "p_type": ["t"] * parts, "p_size": [5] * parts, "p_retailprice": [900.0] * parts}),
        "orders": pa.table({"o_orderkey": range(len(rows)), "o_custkey": [7] * len(rows), "o_orderdate": range(len(rows))}),
        "lineitem": pa.table(dict(zip(("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"), zip(*rows)))).append_column("l_discount", pa.array([0.05] * len(rows))),
    }
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=64)
    small_splits(2048)
    reasons = {r[0] for r in Q.explanations(spark, f"file://{tmp_path}").select("recommendation_reason").collect()}
    assert reasons == {"Recommended because it is similar to your playlist in energy, valence, and acousticness."}


def slow_bootstrap(rows, samples, level, seed):
    out = {}
    for s in sorted({r[1] for r in rows}):
        values = [v for _, _, v in sorted(r for r in rows if r[1] == s and r[2] is not None)]
        n, means = len(values), []
        for b in range(samples):
            draws = [int(hashlib.md5(f"{seed}:{s}:m:{b}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in range(n)]
            means.append(sum(values[int(u * n)] for u in draws) / n)
        means.sort()
        at = lambda q: (lambda x: means[int(x)] + (x - int(x)) * (means[min(int(x) + 1, samples - 1)] - means[int(x)]))(q * (samples - 1))  # noqa: E731, B023
        out[s] = (sum(values) / n, at((1 - level) / 2), at((1 + level) / 2))
    return out


@pytest.mark.parametrize("block", [16_384, 41])
def test_bootstrap_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rng = random.Random(block)
    rows = [(f"p{i}", s, None if rng.random() < 0.1 else rng.random()) for i in range(150) for s in ("x", "y")] + [("p0", "one", 0.5)]
    df = spark.createDataFrame(rows, "playlist_id string, strategy string, m double").repartition(5)
    got = {r.strategy: (r["mean"], r.ci_low, r.ci_high) for r in K.bootstrap(df, ["m"], 30, 0.9, 11).collect()}
    want = slow_bootstrap(rows, 30, 0.9, 11)
    assert set(got) == set(want) and all(abs(a - b) < 1e-12 for s in want for a, b in zip(got[s], want[s]))


def test_numbers_within_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), f"k{i:05d}") for i in range(3000)] + [("c", None), ("c", "z"), (None, "q"), (None, "r")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k string")
    for cuts in (20,):
        out = numbered(df, ["g"], "k", cuts=cuts)
        got = {(r.g, r.k): r.place for r in out.collect()}
        for g in ("a", "b", "c", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or ""))
            assert [got[r] for r in own] == list(range(len(own)))
    assert numbered(df.limit(0), ["g"], "k").count() == 0


# matching


def test_a_title_of_very_many_rows_matches_within_its_band(spark):
    n = 20_000
    catalog = spark.range(n).select(
        F.format_string("t%08d", "id").alias("track_id"), F.lit("Song").alias("title_raw"), F.lit("song").alias("title_canon"), F.lit("band").alias("artist_primary_canon"),
        (F.col("id") % 97).cast("int").alias("popularity"), F.lit(2000).alias("release_year"), (100_000 + F.col("id") * 10).cast("int").alias("duration_ms"),
    )
    items = M.identify(spark.range(n).select((F.col("id") % 7).cast("string").alias("playlist_id"), F.col("id").alias("position"), F.lit(None).cast("string").alias("source_track_id"), F.lit("Song").alias("title"), F.array(F.lit("Band")).alias("artists"), F.when(F.col("id") % 10 != 0, 100_000 + F.col("id") * 10).alias("duration_ms")))
    start = time.time()
    got = M.match_by_metadata(items, catalog).join(items, ["playlist_id", "item_key"])
    # of the rows within 2 s, the most popular, then the first id: of 401 in a row one has popularity 96
    near = F.col("catalog_track_id").substr(2, 8).cast("long")
    far = got.where("duration_ms is not null").where(F.abs(100_000 + near * 10 - F.col("duration_ms")) > TOL).count()
    worse = got.where(near % 97 != 96).where("duration_ms is not null").where(F.col("position").between(200, n - 201)).count()
    assert (got.count(), far, worse) == (n, 0, 0) and time.time() - start < 180
    assert {r[0] for r in got.where("duration_ms is null").select("catalog_track_id").distinct().collect()} == {"t00000096"}
    text = plan(M.match_by_metadata(items, catalog))
    assert "share" in text and "bin" in text and "Cartesian" not in text


def test_items_without_an_id_are_no_single_tasks(spark):
    """Of 30,000 items two thirds have no id: dealt by what they are joined by, no partition has many more than its share, and each item is read once."""
    catalog = spark.range(500).select(F.col("id").cast("string").alias("track_id"), F.format_string("Song %d", F.col("id")).alias("title_raw"), F.format_string("song %d", F.col("id")).alias("title_canon"), F.lit("band").alias("artist_primary_canon"), F.lit(1).alias("popularity"), F.lit(2000).alias("release_year"), F.lit(100_000).alias("duration_ms"))
    k = F.col("id")
    rows = spark.range(30_000).select((k % 100).cast("string").alias("playlist_id"), k.alias("position"), F.when(k % 3 == 0, (k % 600).cast("string")).alias("source_track_id"), F.format_string("Song %d", k % 600).alias("title"), F.array(F.lit("Band")).alias("artists"), F.when(k % 2 == 0, 101_999).alias("duration_ms"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = M.identify(rows)
        sizes = [len(p) for p in M.match_by_id(items, catalog).select("position").rdd.glom().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 30_000 / 2
        got = {r.position: r.catalog_track_id for r in M.match_items(items, catalog).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    assert got == {i: str(i % 600) if i % 600 < 500 else None for i in range(30_000)}


# text


def test_fold_of_every_character_stays_in_the_jvm(spark):
    import unicodedata

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)] + [chr(c) for s, _ in _fold_steps()[1:] for c in map(ord, s)] + ["", None, "ascii", "Ünï½code ﬁ – x́", "à֮̕b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_ascii(F.col("t")).alias("f"))
    assert "Python" not in plan(df)
    for r in df.collect():
        assert r.f == unicodedata.normalize("NFKD", r.t or "").encode("ascii", "ignore").decode(), r.t


# the published catalog


def scanned(df):
    """Rows that the scans of a finished query have put out."""
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


def test_point_lookups_skip_most_of_a_published_catalog(spark, tmp_path, monkeypatch):
    from crossfade.operators import retrieve as C
    from crossfade.schema import DEPLOYED_TYPES

    monkeypatch.setattr(sinks, "ROW_GROUP", 2000)
    n = 100_000
    catalog = spark.range(n).select(*[(F.md5(F.col("id").cast("string")) if c == "track_id" else F.lit(None)).cast(t).alias(c) for c, t in DEPLOYED_TYPES.items()])
    folder = str(tmp_path / "catalog")
    table = S.read_catalog(spark, sinks.publish_catalog(catalog, folder, "v1"))
    ids = [hashlib.md5(str(i).encode()).hexdigest() for i in (5, 77_777, 31_000)]
    for df, want in ((C.lookup(table, ids[0]), ids[:1]), (C.load_tracks(table, ids), ids), (C.lookup(table, "absent"), []), (C.load_tracks(table, ["absent", ids[1]]), ids[1:2])):
        rows = df.collect()
        assert [r.track_id for r in rows] == want and scanned(df) < n / 5
    assert table.count() == n


# requests


def test_a_policy_without_a_seed_draws_anew(spark, sf):
    from dataclasses import replace

    from crossfade.operators.retrieve import prepare
    from crossfade.plans import queries as Q
    from crossfade.plans.policy import DEPLOYED
    from crossfade.plans.recommend import recommend_prepared

    catalog, seeds = Q._request(spark, sf)
    prepared = prepare(catalog, seeds, 10)
    drawn = lambda policy: tuple(r.track_id for r in recommend_prepared(prepared, seeds, 10, policy).rows.collect())
    plain = replace(DEPLOYED, use_pca=False)
    assert len({drawn(plain) for _ in range(3)}) > 1
    assert len({drawn(replace(plain, seed=7)) for _ in range(2)}) == 1
    recommend_prepared(prepared, seeds, 10, plain).release()
    catalog.unpersist()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    rows = Q.recommend_weighted(spark, sf)
    assert rows.count() == 10 and spark.sparkContext._jsc.getPersistentRDDs().size() <= 1
    Q._kept(spark.range(1)).unpersist()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_labels_of_a_block_at_a_time(spark, sf):
    from crossfade.plans import queries as Q

    assert sorted(Q.embedding_cosine(spark, sf, block=3).collect()) == sorted(Q.embedding_cosine(spark, sf).collect())


def test_a_sample_reads_a_part_of_a_table_in_the_order_of_draws(spark, tmp_path, monkeypatch):
    from crossfade.operators import retrieve as C
    from crossfade.schema import DEPLOYED_TYPES

    monkeypatch.setattr(sinks, "ROW_GROUP", 1000)
    n = 60_000
    given = {"track_id": F.concat(F.lit("t"), F.col("id")), "title_canon": F.lit("x"), "popularity": F.when(F.col("id") % 7 != 0, F.col("id") % 100)}
    catalog = spark.range(n).select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in DEPLOYED_TYPES.items()])
    artifact = sinks.publish_catalog(catalog, str(tmp_path / "c"), "v1")
    ordered = spark.read.parquet(sinks.publish_draws(spark, artifact))
    assert sinks.publish_draws(spark, artifact) == f"{artifact}.draws-0" and ordered.count() == n
    table = S.read_catalog(spark, artifact)
    for limit, least, share in ((500, 60, 0.3), (5000, 99, 1.1)):
        choose = lambda df: C.filter_candidates(df, ["t5"], None, least)  # noqa: B023, E731
        want = C.bounded_sample(choose(table), limit).collect()
        part = C.ordered_sample(ordered, limit, choose) if limit else C.ordered_sample(ordered, 1, choose).limit(0)
        got = part.collect()
        assert [r.track_id for r in got] == [r.track_id for r in want] and part.columns == table.columns
        assert scanned(part) < share * n
    seeds = table.where("track_id in ('t1', 't2')")
    pools = [C.prepare(table, seeds, 10, 50, limit=700, ordered=o) for o in (None, ordered)]
    assert sorted(r.track_id for r in pools[0].candidates.collect()) == sorted(r.track_id for r in pools[1].candidates.collect()) and pools[0].pool_size == pools[1].pool_size == 700
    for p in pools:
        p.release()


def test_draws_are_parted_once_whatever_the_number_of_blocks():
    """Draws of a resample by block of values: one row a block that has any, each draw once, as the md5 rule has them."""
    import pyarrow as pa

    names = ["strategy", "metric", "b", "n", "first", "last"]
    rows = pa.RecordBatch.from_pylist([dict(zip(names, ("s", "m", 3, 1000, 200, 799), strict=True))])
    got = pa.Table.from_batches(list(K._parted(iter([rows]), 7, 4))).to_pylist()
    want = sorted(int(int(hashlib.md5(f"7:s:m:3:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) * 1000) for i in range(200, 800))
    assert [r["block"] * 4 + x for r in got for x in r["at"]] == want
    assert len(got) == len({r["block"] for r in got}) == len({w // 4 for w in want})


def test_many_draws_are_those_of_one_by_one():
    import hashlib

    from crossfade.functions.draws import units

    for head in ("0:a:ndcg_at_k:3:", "0:weighted_cosine_pca_steered:avg_recommendation_popularity:49:", "x" * 64, "é" * 70):
        for first, last in ((0, 300), (99_950, 100_200), (7, 7), (3, 2)):
            one = [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in range(first, last + 1)]
            assert units(head, first, last).tolist() == one


def test_resamples_of_a_metric_are_no_single_task_and_shuffle_no_draws(spark, monkeypatch):
    from pyspark.sql import functions as F

    from crossfade.operators import metrics as K

    rows = spark.range(3000).select(F.col("id").cast("string").alias("playlist_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("strategy"), (F.col("id") % 97 / 97).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 11 / 7).alias("y"))
    read = lambda: {(r.strategy, r.metric): tuple(round(v, 9) for v in r[2:]) for r in K.bootstrap(rows, ("x", "y"), 20, 0.9, 5).collect()}
    whole = read()
    plan = K.bootstrap(rows, ("x", "y"), 20, 0.9, 5)._jdf.queryExecution().toString()
    assert "array<int>" not in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(K, "WHOLE", 100)
    assert read() == whole and len(whole) == 4


def test_rollup_reads_items_once(spark, sf):
    """the rollup joined a second reading of all items, for numbers that it doesn't have."""
    from crossfade.operators import match as M
    from crossfade.plans import queries as Q
    from crossfade.sources import fixtures as S

    items = S.playlist_items(spark, sf)
    summary = M.match_summary(items, M.playlist_labels(items, S.catalog(spark, sf)))
    got = Q.match_rollup(spark, sf)
    assert got.select("num_playlists", "total_tracks", "matched_tracks").collect() == M.rollup_summary(summary).select("num_playlists", "total_tracks", "matched_tracks").collect()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("o_orderkey#") and got._jdf.queryExecution().optimizedPlan().toString().count("Relation [o_orderkey") == 1
