import json
import os

import pytest
from pyspark.sql import functions as F

from crossfade.functions import text as T
from crossfade.operators import match as M
from crossfade.operators import merge as G
from crossfade.schema import CatalogError
from crossfade.sources import sinks as K
from crossfade.sources import tables as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "title,canon",
    [
        ("Cafe del Mar - Radio Edit", "cafe del mar"), ("Halo (Remastered 2011)", "halo"), ("Sweetest Thing!!!", "sweetest thing"), ("Twenty-One - Live", "twenty"), ("Song (Live) (feat. X)", "song live feat x"),
        ("Song (feat. X) [Live] {clean}", "song feat x"), ("Ｆull ﬁne", "full fine"), ("A B", "a b"), (None, ""), ("Alive - Olive", "alive olive"), ("x - y\nlive", "x y live"),
    ],
)
def test_titles(spark, title, canon):
    assert one(spark, T.canon_title, title) == canon


@pytest.mark.parametrize("text,canon", [("['Beyoncé', 'X']", "beyonce"), ("Tyler, The Creator", "tyler"), ("[broken, 'x", "[broken"), ("AC/DC", "ac/dc"), (None, "")])
def test_primary_artists(spark, text, canon):
    assert one(spark, T.canon_artist_text, text) == canon


def test_small_functions(spark):
    assert one(spark, T.playlist_id, "https://x/playlist/Ab1?y") == "Ab1" and one(spark, T.playlist_id, "service:playlist:Zz") == "Zz" and one(spark, T.playlist_id, "no!") is None
    with pytest.raises(Exception, match="not a playlist"):
        one(spark, T.require_playlist_id, "no!")
    assert [one(spark, T.parse_bool, v) for v in ("False", "YES", "0", "x", None)] == [False, True, False, None, None]
    assert one(spark, T.track_id, " service:track:9 ") == "9" and one(spark, T.track_id, "  ") is None
    assert one(spark, T.artist_display, ["A", " ", "B "], "array<string>") == "A, B" and one(spark, T.artist_display, None, "array<string>") == "Unknown artist"
    assert one(spark, T.setting_to_adjustment, 10.0, "double") == 0.5 and one(spark, T.setting_to_adjustment, -4.0, "double") == -0.5
    with pytest.raises(Exception, match="finite"):
        one(spark, T.setting_to_adjustment, float("nan"), "double")
    images = lambda *u: one(spark, T.image_url, [(x,) for x in u], "array<struct<url:string>>")
    assert images("a", "b", "c") == "b" and images("a") == "a" and images() is None
    assert one(spark, lambda c: T.track_uri(c), " ") is None and one(spark, lambda c: T.track_uri(c), "7") == "track:7"


def test_headers_are_mapped():
    m = S.map_header(["URI", "Track_Name", "artist_name", "Duration_ms", "Is_Explicit", "track_popularity", "Year", "Energy"])
    assert (m["id"], m["name"], m["artists"], m["duration"], m["explicit"], m["popularity"], m["release_year"], m["energy"]) == ("URI", "Track_Name", "artist_name", "Duration_ms", "Is_Explicit", "track_popularity", "Year", "Energy")
    assert S.map_header(["x"])["isrc"] is None


def frames(spark):
    chart = spark.createDataFrame([("chart-track", "Chart Song", "Tyler, The Creator, Kali Uchis", "200000")], "id string, track_name string, artist_names string, duration_ms string")
    catalog = spark.createDataFrame([("catalog-track", "Catalog Song", "Tyler, The Creator", "210000")], "track_id string, track_name string, artist_name string, duration_ms string")
    return [chart, catalog]


@pytest.mark.parametrize("bound", [20_000, 0])
def test_known_names_with_commas_stay_whole(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "KNOWN_BOUND", bound)  # by a broadcast map, then by a join
    rows = {r.track_id: r for r in G.merge_tables(frames(spark)).collect()}
    assert rows["chart-track"].artists_raw == ["Tyler, The Creator", "Kali Uchis"] and rows["chart-track"].artist_primary_canon == "tyler, the creator"
    assert rows["catalog-track"].artists_raw == ["Tyler, The Creator"]




def brute_merge(rows, key):
    groups, rest = {}, []
    for r in rows:
        k = key(r)
        groups.setdefault(k, []).append(r) if k is not None else rest.append(r)
    out = []
    for rs in groups.values():
        a = dict(rs[0])
        for b in rs[1:]:
            a["id"] = a["id"] or b["id"]
            a["isrc"] = a["isrc"] or b["isrc"]
            a["title"] = a["title"] if len(a["title"]) >= len(b["title"]) else b["title"]
            a["pop"] = max((x for x in (a["pop"], b["pop"]) if x is not None), default=None)
            a["energy"] = a["energy"] if a["energy"] is not None else b["energy"]
            if a["dur"] is None:
                a["dur"] = b["dur"]
            elif b["dur"] is not None and abs(a["dur"] - b["dur"]) <= 2000:
                a["dur"] = max(a["dur"], b["dur"])
        out.append(a)
    return out + rest


def test_three_passes_are_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [{"id": rng.choice([None, *"abcdefgh"]), "isrc": rng.choice([None, None, "I1", "I2", "I3", "I4"]), "title": rng.choice(["", "one", "One!", "two", "two (live)"]), "pop": rng.choice([None, 1, 5, 9]),
             "dur": rng.choice([None, 4500, 3000, 6000, 7500, 7600]), "energy": rng.choice([None, 0.25, 0.5])} for _ in range(60)]
    df = spark.createDataFrame([(i, r["id"], r["isrc"], r["title"], r["pop"], r["dur"], r["energy"]) for i, r in enumerate(rows)], "ord long, id string, isrc string, name string, popularity string, duration_ms string, energy string")
    df = df.select("ord", *[F.col(c).cast("string").alias(c) for c in df.columns[1:]], F.lit("Band").alias("artist"))
    canon = {"": "", "one": "one", "One!": "one", "two": "two", "two (live)": "two"}
    want = brute_merge(rows, lambda r: r["id"])
    want = brute_merge(want, lambda r: r["isrc"])
    want = brute_merge(want, lambda r: (canon[r["title"]], round(r["dur"] / 3000)) if canon[r["title"]] and r["dur"] is not None else None)
    seen, kept = set(), []
    for r in want:
        k = (r["id"], r["isrc"], canon[r["title"]], r["dur"])
        if k not in seen:
            seen.add(k)
            kept.append((r["id"], r["isrc"], r["title"], r["pop"], r["dur"], r["energy"]))
    got = G.merge_tables([df]).orderBy("ord").collect()
    assert [(r.track_id, r.isrc, r.title_raw, r.popularity, r.duration_ms, r.energy) for r in got] == kept


def test_normalisation_of_odd_values(spark):
    df = spark.createDataFrame([(None, None, "['A', 'B']", "200000.7", "1.5", "-1", "2011-05", "x")], "id string, name string, artists string, duration_ms string, energy string, tempo string, year string, popularity string")
    r = G.normalize(df).first()
    assert (r.track_id, r.title_raw, r.artists_raw, r.duration_ms, r.energy, r.tempo, r.release_year, r.popularity) == (None, "", ["A", "B"], 200000, 1.0, None, 2011, None)
    with pytest.raises(ValueError):
        G.merge_by_canon(G.normalize(df), 0)


def catalog(spark, rows):
    full = [(i, t, a, d, p, y) for i, t, a, d, p, y in rows]
    df = spark.createDataFrame(full, "track_id string, title_raw string, artist string, duration_ms int, popularity int, release_year int")
    return df.select("*", F.array("artist").alias("artists_raw"), T.canon_title(F.col("title_raw")).alias("title_canon"), T.canon_artist(F.array("artist")).alias("artist_primary_canon"))


def items(spark, rows):
    return spark.createDataFrame(rows, "playlist_id string, position long, source_track_id string, title string, artists array<string>, duration_ms long")


def test_matching_rules(spark):
    cat = catalog(spark, [("i1", "Other", "Band", 1000, 1, 1), ("c1", "Song", "Band", 199000, 40, 1983), ("c2", "Song - Live", "Band", 199000, 95, 2021), ("c3", "Far", "Band", 240000, 5, 2000)])
    got = {r.position: r.catalog_track_id for r in M.playlist_labels(items(spark, [("p", 0, "i1", "Song", ["Band"], 199000), ("p", 1, "zz", "Song", ["Band"], 198500), ("p", 2, None, "Far", ["Band"], 180000), ("p", 3, None, "Far", ["Band"], None), ("p", 4, None, None, None, None)]), cat).collect()}
    assert got == {0: "i1", 1: "c1", 2: None, 3: "c3", 4: None}


def test_labels_keep_misses_and_first_positions(spark):
    cat = catalog(spark, [("a", "A", "X", 1000, 1, 1)])
    rows = [("p", 0, "a", "A", ["X"], 1000), ("p", 1, "a", "A", ["X"], 1000), ("p", 2, None, "Gone", ["Y"], 5), ("p", 3, "q", "Gone", ["Y"], 5)]
    labels = M.playlist_labels(items(spark, rows), cat)
    assert sorted((r.position, r.matched) for r in labels.collect()) == [(0, True), (2, False), (3, False)]
    s = M.match_summary(items(spark, rows), labels, 1).first()
    assert (s.total_source_tracks, s.total_unique_source_tracks, s.duplicate_tracks_removed, s.matched_unique_tracks, s.included) == (4, 3, 1, 1, True) and s.match_rate == pytest.approx(1 / 3)
    kept, summary = M.build_labels(items(spark, rows), cat, 2)
    assert kept.count() == 0 and summary.count() == 1 and M.rollup_summary(summary).first().match_rate == pytest.approx(1 / 3)


def test_playlist_pages(spark):
    body = lambda *xs: json.dumps({"items": list(xs)})
    track = {"id": "1", "name": "A", "artists": [{"name": "X"}], "duration_ms": 5}
    df = spark.createDataFrame([("p", 0, body({"track": track}, {"track": None}, {"item": track})), ("p", 1, body({"track": track})), ("q", 0, None)], "playlist_id string, page int, body string")
    assert [(r.position, r.track.id) for r in S.read_playlist_pages(df).orderBy("position").collect()] == [(0, "1"), (2, "1"), (3, "1")]


def test_pages_are_followed_and_pictures_picked(spark):
    store = {"u0": {"items": [{"track": {"id": "1"}}], "next": "u1"}, "u1": {"items": [{"item": {"id": "2"}}], "next": None}, "v0": {"items": [], "next": "v0"}}
    first = spark.createDataFrame([("p", "u0"), ("q", "v0"), ("r", None)], "playlist_id string, url string")
    pages = S.fetch_pages(first, lambda url: json.dumps(store[url]))
    assert sorted((r.playlist_id, r.page) for r in pages.collect()) == [("p", 0), ("p", 1), ("q", 0)]
    assert [(r.position, r.track.id) for r in S.read_playlist_pages(pages).orderBy("position").collect()] == [(0, "1"), (1, "2")]
    art = {"a": ["big", "mid", "small"], "b": ["only"], "c": []}
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "track_id string")
    assert [r.album_art_url for r in S.attach_art(rows, lambda i: art[i]).orderBy("track_id").collect()] == ["mid", "only", None, None]


def test_names_are_known_without_regard_to_case(spark):
    known = spark.createDataFrame([("Strauß, Söhne",), ("ΟΔΟΣ, Α",)], "artist_name string").select("artist_name")
    df = spark.createDataFrame([("STRAUSS, söhne, Solo",), ("οδος, α, X",), ("a, b",)], "artist_names string")
    from crossfade.operators import merge as G

    rows = G.union_normalized([known, df]).where("size(artists_raw) > 1").select("artists_raw").collect()
    assert sorted(r.artists_raw for r in rows) == sorted([["Strauß, Söhne", "Solo"], ["ΟΔΟΣ, Α", "X"], ["a", "b"]])


def test_artists_are_shown(spark):
    texts = ["['A', ' B ']", " Solo ", "", None, "[broken", "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.artist_display_text(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == ["A, B", "Solo", "Unknown artist", "Unknown artist", "[broken", "Unknown artist"]


def test_csv_source_and_cache(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write('id,name,artist,duration_ms\n1,"A ""q""",X,1000\n2,None,Y,NA\n')
    assert S.csv_header(spark, path) == ["id", "name", "artist", "duration_ms"] and S.csv_rows(spark, [path]) == 2
    rows = S.read_csv(spark, path).orderBy("id").collect()
    assert (rows[0].name, rows[1].name, rows[1].duration_ms) == ('A "q"', None, None)
    cache = str(tmp_path / "cache")
    first = K.merged_catalog(spark, [path], cache)
    assert first.count() == 2 and K.merged_catalog(spark, [path], cache).count() == 2 and len(os.listdir(cache)) == 1
    with pytest.raises(ZeroDivisionError):
        K.cached(spark, [path], cache, lambda write: 1 / 0, rebuild=True)
    assert [x for x in os.listdir(cache) if x.startswith(".")] == []


def test_publishing(spark, tmp_path, sf):
    from crossfade.sources import fixtures as X

    folder = str(tmp_path / "out")
    cat = X.catalog(spark, sf)
    path = K.publish_catalog(cat, folder, "v1")
    assert os.path.basename(path).startswith("catalog-v1-") and S.current_artifact(folder) == path
    back = K.catalog_bundle(spark, folder)
    assert dict(back.dtypes)["popularity"] == "float" and dict(back.dtypes)["release_year"] == "smallint" and back.count() == cat.count()
    assert S.row_count(spark, "file://" + path) == cat.count() and S.empty_like(back).count() == 0
    with pytest.raises(CatalogError):
        K.publish_catalog(cat.limit(0), folder, "v2")
    assert S.current_artifact(folder) == path and len(os.listdir(folder)) == 2
    with pytest.raises(ValueError):
        K.publish_catalog(cat, folder, "v/1")
    (tmp_path / "out" / "CURRENT").write_text("../x\n")
    with pytest.raises(CatalogError):
        S.current_artifact(folder)
    assert S.current_artifact(folder, "/else") == "/else" and S.first_existing(["/nope", folder]) == folder


def test_lists_and_small_files(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("# c\n b \n\na\nb\n")
    assert S.read_list(spark, str(p), ["a ", "c"]) == ["a", "c", "b"] and S.read_id_filter(spark, str(p)) == {"a", "b"}
    j = tmp_path / "t.json"
    j.write_text(json.dumps({"partition": {"test_playlist_ids": [1, "2"]}, "selected_weights": {"energy": 2}}))
    assert S.read_id_filter(spark, str(j)) == {"1", "2"} and S.read_weights(str(j)) == {"energy": 2.0}
    K.write_csv(spark.createDataFrame([(1, "a,b")], "x int, y string"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == 'x,y\n1,"a,b"\n'
    K.write_csv(spark.createDataFrame([], "x int, y string"), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text() == "x,y\n"
    K.write_json({"a": float("nan"), "b": [1.5, None]}, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": None, "b": [1.5, None]}


def test_raw_rows_of_one_block_are_dealt_out(spark):
    """the text work of a file of one block was one task's, and each text was parsed row by row."""
    raw = spark.range(0, 200, 1, 1).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("track_id"), F.concat(F.lit("T "), "id").alias("name"), F.lit("A, B").alias("artist_names"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = G.union_normalized([raw])
        sizes = [n for n in rows.rdd.mapPartitions(lambda b: [sum(1 for _ in b)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes) > 1 and max(sizes) < 100
    got = rows.select("ord", "track_id", F.array_join("artists_raw", "|").alias("a")).collect()
    assert sorted(map(tuple, got)) == [(i, str(i), "A|B") for i in range(200)]
    # without a known name nothing is joined to the rows, and no Python fold is asked for
    assert G.with_known(raw, G.known_names([raw]))[1] is None


def test_a_known_name_is_its_first_spelling_of_many_rows(spark):
    named = spark.createDataFrame([("1", "earth, Wind"), ("2", "Earth, wind"), ("3", "earth, Wind"), ("4", "solo")], "id string, artist_name string").coalesce(1)
    known = G.known_names([named])
    assert [tuple(r) for r in known.collect()] == [("earth\x1fwind", "earth, Wind")]
    listed = spark.createDataFrame([("A, EARTH , WIND, b",), ("Earth",), (None,), ("",)], "artist_names string")
    rows, names = G.with_known(listed, known)
    assert [r[0] for r in rows.select(T.parse_artists(F.col("artist_names"), "artist_names", names)).collect()] == [["A", "earth, Wind", "b"], ["Earth"], [], []]


def test_a_list_that_many_rows_share_is_parsed_once(monkeypatch):
    import pandas as pd

    calls, parse = [], T.ast.literal_eval
    monkeypatch.setattr(T.ast, "literal_eval", lambda x: calls.append(x) or parse(x))
    texts = ["['a', ' b ']", None, "[1", "['a', ' b ']", "[]"] * 100
    assert list(T._literal_list.func(pd.Series(texts, dtype=object))) == [["a", "b"], None, None, ["a", "b"], []] * 100
    assert sorted(calls) == ["['a', ' b ']", "[1", "[]"]


def test_artists_are_worked_out_once_for_the_list_and_its_first_name(spark):
    rows = spark.createDataFrame([("1", "t", " B , c")], "track_id string, name string, artist_names string")
    out = G.normalize(rows)
    assert [(r.artists_raw, r.artist_primary_canon) for r in out.collect()] == [(["B", "c"], "b")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the text is split at its commas in one place
    assert plan.count(", ,, -1)") == 1
