import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_scans import ODD, rows_of, save

from crossfade.llm.components import components
from crossfade.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from crossfade.llm.packing import best_fit, measure, pack, pack_documents
from crossfade.llm.quality_knn import fit_quality, held_out, keep_quality, score_quality
from crossfade.llm.queries import op2_best_fit_packing, op4_token_counts, op5_quality_knn, op6_minhash_dedup, op7_kdtree_topk
from crossfade.llm.token_counts import VOCABULARY, TokenRollup, _encoding
from crossfade.llm.topk_kdtree import Tree, top_k

# components


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_stars_chains_and_repeats(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges += [(5, 5), (7, 3), (3, 7)] * 3
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(df.limit(0)).count() == 0


# near-duplicates


def shingles(text, width=2):
    from test_scans import ASCII

    own = [w for w in (text or "").translate(ASCII).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not own:
        return set()
    return {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)}


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute_components(edges)
    return {i: (len(sets[i]), comp.get(i, i)) for i in ids}


def near_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = list(ODD) + ["a", "A", "a b", "A  B", "a b a b a b"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 90))]
        for k in range(8):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts += [" ".join(own), " ".join(own).upper()]
    return texts


def test_near_duplicates_are_brute_force(spark, tmp_path):
    texts = near_texts()
    d = save(spark, tmp_path, documents=rows_of(spark, texts, kept="clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_minhash_dedup(spark, d).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_large_groups_go_in_blocks(spark, monkeypatch):
    from crossfade.llm import minhash_dedup as D

    monkeypatch.setattr(D, "BLOCK_CLASSES", 4)  # many block pairs for one bucket
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows_of(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_duplicates_without_ids_and_with_repeats(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(None, same), (4, same), (4, same), (9, same), (None, "other words here"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == sorted([("None", "4", False), ("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", False), ("7", "7", True)])
    assert near_duplicates(df.limit(0)).count() == 0


def test_rows_are_dropped_one_by_one(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "alone in the world of words"
    rows = [(5, a, "x"), (3, a, "x"), (5, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (7, c, "y"), (7, c, "z"), (None, None, "x"), (None, None, "x"), (8, "", "x"), (8, " \t\n", "x"), (9, a.upper(), "x")]
    # an unrelated repeated id, and names that an operator might want for itself
    df = spark.createDataFrame([*rows, (70, "far away", "x"), (70, "far off", "x")], "doc_id long, text string, bit_hash string")
    df = df.select("*", *[F.lit("clash").alias(n) for n in ("_bit_hash", "_gone", "mark", "keep", "row", "k", "wanted", "kept", "rep", "a.b")])
    out = drop_near_duplicates(df)
    assert out.schema == df.schema
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    want = [("3", a), ("5", b), ("7", c), ("None", None), ("None", None), ("8", ""), ("8", " \t\n"), ("70", "far away"), ("70", "far off")]
    assert sorted(got, key=str) == sorted(((i, t) for i, t in want), key=str)
    assert drop_near_duplicates(df.limit(0)).count() == 0
    only = spark.createDataFrame([(None, a), (None, a), (None, a + " seven")], "doc_id long, text string")
    assert [r.doc_id for r in drop_near_duplicates(only).collect()] == [None]


# packing


def check_bins(out, capacity):
    held, sources, clusters = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in out:
        if r.bin is None:
            assert r.n_words == 0
            continue
        b = (r.shard, r.bin)
        assert 0 <= r.offset and r.offset + r.n_words <= capacity
        held[b] += r.n_words
        sources[b].append(r.source)
        clusters[b].append(r.cluster)
    for b in held:
        assert held[b] <= capacity
        for group in (sources[b], clusters[b]):
            some = [x for x in group if x is not None]
            assert len(some) == len(set(some))
        spans = sorted((r.offset, r.offset + r.n_words) for r in out if (r.shard, r.bin) == b)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    return held


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 60, 400))[::-1]
    sources, clusters = rng.integers(-1, 6, 400), rng.integers(-1, 200, 400)
    bins, offsets = best_fit(sizes, sources, clusters, 100)
    # replay: every choice was the least sufficient room among the compatible bins
    state = {}
    for i in range(400):
        fits = {b: 100 - u for b, (u, s, c) in state.items() if 100 - u >= sizes[i] and (sources[i] < 0 or sources[i] not in s) and (clusters[i] < 0 or clusters[i] not in c)}
        if bins[i] in state:
            assert fits[bins[i]] == min(fits.values()) and offsets[i] == state[bins[i]][0]
        else:
            assert not fits and offsets[i] == 0
        u, s, c = state.get(bins[i], (0, set(), set()))
        state[bins[i]] = (u + sizes[i], s | {sources[i]}, c | {clusters[i]})


def test_packing_query_holds_every_word(spark, tmp_path):
    rng = random.Random(4)
    texts = ODD + [" ".join("w" for _ in range(rng.randrange(1, 3000))) for _ in range(80)] + ["same text", "Same  TEXT", "same text"]
    df = spark.createDataFrame([(i, t, rng.choice(["a", "a", "a", "b", None])) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = op2_best_fit_packing(spark, save(spark, tmp_path, documents=df)).collect()
    check_bins(out, 1024)
    per = defaultdict(list)
    for r in out:
        per[r.doc_id].append((r.start, r.n_words))
    from test_scans import re

    for i, t in enumerate(texts):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        at = sorted(per[i])
        assert sum(k for _, k in at) == n and [a for a, _ in at] == list(range(0, max(n, 1), 1024))


def test_packing_query_is_brute_force(spark, tmp_path):
    """Longest first, then by row and piece, each piece into the least sufficient room of the compatible bins, of equal rooms into any."""
    from test_scans import re

    rng = random.Random(14)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 200, 500, rng.randrange(1, 2600)]))) for _ in range(150)] + ["same text", "Same  TEXT", None, "x " * 5000]
    df = spark.createDataFrame([(i, t, rng.choice(["a", "b", "c", None, f"s{i}"])) for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    out = {(r.doc_id, r.piece): r for r in op2_best_fit_packing(spark, save(spark, tmp_path, documents=df)).collect()}
    pieces, seen = [], {}
    for i, t in enumerate(texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        key = seen.setdefault(tuple(w.lower() for w in own), i)
        for k in range(0, max(len(own), 1), 1024):
            pieces.append((-min(len(own) - k, 1024), i, k // 1024, key))
    assert set(out) == {(i, k) for _, i, k, _ in pieces}
    state = {}
    for size, i, k, key in sorted(pieces):
        r, size = out[i, k], -size
        assert (r.n_words, r.start) == (size, 1024 * k)
        if not size:
            assert r.bin is None
            continue
        fits = {b: 1024 - used for b, (used, sources, keys) in state.items() if 1024 - used >= size and r.source not in sources and key not in keys}
        if r.bin in state:
            assert fits[r.bin] == min(fits.values()) and r.offset == state[r.bin][0]
        else:
            assert not fits and r.offset == 0 and r.bin == len(state)
        used, sources, keys = state.get(r.bin, (0, set(), set()))
        state[r.bin] = (used + size, sources | ({r.source} - {None}), keys | {key})


def test_packing_in_shards_with_repeated_rows(spark):
    rows = [(1, "s", 30, 5)] * 50 + [(i, None, 10, None) for i in range(100)] + [(None, "t", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_words long, cluster long")
    out = pack(df, 100, shard_pieces=20).collect()
    assert len(out) == 151 and len({r.shard for r in out}) > 3
    check_bins(out, 100)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_clusters_come_back_as_measured(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    big = (1 << 60) + 1  # ids and digests that a float would round
    df = spark.createDataFrame([(big + i, t, "s") for i, t in enumerate(texts)] + [(big + 100, None, None), (None, "", "s"), (None, "no id", "s"), (big + 101, " ", "s")], "doc_id long, text string, source string")
    want = sorted((str(r.doc_id), str(r.cluster)) for r in measure(df).collect())
    out = pack_documents(df, 1024).collect()
    assert sorted((str(r.doc_id), str(r.cluster)) for r in out) == want and len({r.shard for r in out}) == 1
    check_bins(out, 1024)


# token counts


def test_rollup_is_additive_and_idempotent(spark):
    r = TokenRollup(spark)
    kind = "op string, doc_id long, version string, source string, lang string, n_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    state = lambda: {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert state() == {}
    first = batch(("insert", 1, "v", "a", "en", 5), ("insert", 2, "v", "a", None, 7), ("insert", 2, "v", "a", None, 3), ("insert", None, "v", "a", "en", 9), ("other", 3, "v", "a", "en", 9))
    assert r.commit("b1", first) and not r.commit("b1", first)
    assert state() == {("a", "en", "v"): (1, 5), ("a", None, "v"): (1, 7)}
    assert r.commit("b2", batch(("revise", 1, "v", "b", "de", 6), ("delete", 2, "v", None, None, None), ("delete", 99, "v", None, None, None), ("insert", 4, "w", None, None, None)))
    assert state() == {("b", "de", "v"): (1, 6), (None, None, "w"): (1, 0)}
    assert not r.commit("b1", first) and r.batches() == ["b1", "b2"]
    assert r.commit("b3", batch(("insert", 2, "v", "a", "fr", 1), ("insert", 1, "v", "b", "de", 8), ("delete", 1, "v", "b", "de", 8)))
    assert state() == {("a", "fr", "v"): (1, 1), (None, None, "w"): (1, 0)}
    with pytest.raises(ValueError):
        r.commit("not/an id", first)


def test_writers_at_one_number_take_turns(spark):
    import threading

    path = TokenRollup(spark).path
    kind = "op string, doc_id long, version string, source string, lang string, n_tokens long"
    rollups = [TokenRollup(spark, path) for _ in range(6)]
    batch = lambda i: spark.createDataFrame([("insert", i % 3, "v", f"s{i}", "en", 10 + i), ("insert", 100 + i, "v", "own", "en", 1)], kind)
    done: dict[int, bool] = {}
    # two writers of each batch id, all at once
    jobs = [threading.Thread(target=lambda n=n, i=i: done.__setitem__(n, rollups[n].commit(f"b{i}", batch(i)))) for n, i in enumerate((0, 1, 2, 0, 1, 2))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sorted(done.values()) == [False] * 3 + [True] * 3
    r = TokenRollup(spark, path)
    assert sorted(r.batches()) == ["b0", "b1", "b2"] and r._log()[1] == 3
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == {("s0", 1, 10), ("s1", 1, 11), ("s2", 1, 12), ("own", 3, 3)}
    # a claim that comes too late fails and leaves the winner's record
    before = r._read_record(2)
    assert not r._claim(2, {"batch": "late"}) and r._read_record(2) == before


def test_compaction_keeps_ledger_totals_and_names(spark, monkeypatch):
    from crossfade.llm import token_counts as C

    monkeypatch.setattr(C, "COMPACT_EVERY", 3)
    rng, state, r = random.Random(12), {}, TokenRollup(spark)
    kind = "op string, doc_id long, version string, source string, lang string, n_tokens long, extra string"
    for n in range(8):
        rows = {}
        for _ in range(rng.randrange(5)):
            i, op = rng.randrange(8), rng.choice(["insert", "revise", "delete"])
            rows[i] = (op, i, "v", rng.choice(["a", None]), "en", rng.randrange(9), "x")
        assert r.commit(f"n{n}", spark.createDataFrame(list(rows.values()), kind))
        for i, x in rows.items():
            state.pop(i, None)
            if x[0] != "delete":
                state[i] = x[3:6]
        assert {x.doc_id: (x.source, x.lang, x.n_tokens) for x in r.ledger().collect()} == state
        want = defaultdict(lambda: [0, 0])
        for source, _, tokens in state.values():
            want[source][0] += 1
            want[source][1] += tokens
        assert {x.source: [x.n_docs, x.n_tokens] for x in r.totals().collect()} == want
        assert not r.commit(f"n{rng.randrange(n + 1)}", spark.createDataFrame([("insert", 1, "v", "a", "en", 99, "x")], kind))
    assert r.batches() == [f"n{n}" for n in range(8)] and len(r._log()[0]) == 3


def test_token_query_is_brute_force(spark, tmp_path):
    texts = [*ODD, "long words and numbers 12345 " * 20_000] + ["the same", "the same", "THE SAME", "words and  more words"]
    rows = [(i, t, ["s", None][i % 2], "en") for i, t in enumerate(texts)]
    d = save(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in op4_token_counts(spark, d).collect()}
    enc, want, seen = _encoding(VOCABULARY), defaultdict(lambda: [0, 0]), set()
    for i, t, s, lang in rows:
        t = t or ""
        if t in seen:
            continue
        seen.add(t)
        for v, n in (("byte-bpe-50k", len(enc.encode_ordinary(t)) + 1), ("words", len(t.encode().split()))):
            want[s, lang, v][0] += 1
            want[s, lang, v][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


# quality


def test_quality_is_learned_and_held_out(spark, sf):
    rows = op5_quality_knn(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    both = rows.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert len(rows) == len(pd.read_parquet(f"{sf}/documents.parquet")) and rows.score.between(0, 1).all()
    assert (both.predicted == both.quality).mean() >= 0.9


def test_scores_depend_on_the_text_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"))), per_label=40)
    assert len(model.labels) <= 80
    odd = rows_of(spark, ODD + ["the same text", "the same text"], source="x", quality="0")
    got = {r.doc_id: r.score for r in score_quality(odd, model).collect()}
    assert len(got) == len(ODD) + 2 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] and got[len(ODD)] == got[len(ODD) + 1]
    few = keep_quality(odd, model, least=2.0)
    assert few.count() == 0 and few.schema == odd.schema
    none = fit_quality(docs, labels.limit(0))
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5} and score_quality(odd.limit(0), none).count() == 0


def test_exact_block_products_are_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels, per_label=30)
    x = np.random.default_rng(0).random((7, model.axes.shape[0]))
    z = (x * model.idf) @ model.axes
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for row, got in zip(z, model.score(x)):
        cos = model.vectors @ row
        near = np.argsort(-cos)[: model.neighbours]
        w = np.clip(cos[near], 0, None) ** 8
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-9)


# top-k


def brute_top_k(rows, asked, k=5):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    vec = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in {i: v for i, v in vec if i in asked}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vec if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_is_brute_force(spark, tmp_path, monkeypatch, scale):
    from crossfade.llm import topk_kdtree as K

    monkeypatch.setattr(K, "PILOT_ROWS", 20)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(700, rows[50][1]), (701, rows[50][1]), (702, None), (750, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (850, [1.0, 2.0]), (851, [3.0, 4.0]), (852, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in op7_kdtree_topk(spark, save(spark, tmp_path, embeddings=df)).collect())
    assert got == brute_top_k(rows, {i for i, _ in rows if i is not None and i % 50 == 0})


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (500, 5)).astype(float)
    tree = Tree(np.arange(500), v, leaf=16)
    q = rng.integers(-50, 50, (20, 5)).astype(float)
    b = tree.bounds(q)
    for n, (lo, hi) in enumerate(tree.ranges):
        assert ((tree.vectors[lo:hi] @ q.T).max(0) <= b[:, n]).all()
