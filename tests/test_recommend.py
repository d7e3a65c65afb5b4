import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfade.functions import features as X
from crossfade.operators import labels as L
from crossfade.operators import metrics as K
from crossfade.operators import rank as R
from crossfade.operators import retrieve as C
from crossfade.operators.pca import fit_pca
from crossfade.plans import benchmark as B
from crossfade.plans import report as P
from crossfade.plans.policy import DEFAULT_STRATEGIES, DEPLOYED, BenchmarkConfig, Policy, Strategy, with_tuned
from crossfade.plans.recommend import recommend, recommend_for_playlist, scored, serve
from crossfade.schema import DEFAULT_WEIGHTS, FEATURES, CatalogError, NoMatchesError
from crossfade.sources import fixtures as S

COLS = "track_id string, title_raw string, title_canon string, artists_raw array<string>, artist_primary_canon string, popularity int, release_year int, danceability double, energy double, valence double, acousticness double, instrumentalness double, liveness double, speechiness double, tempo double, loudness double, duration_ms int"


def row(i, dance=0.5, energy=0.5, artist="artist", pop=80, year=2020, tempo=120.0):
    return (i, f"Track {i}", f"track {i}", [artist], artist, pop, year, dance, energy, 0.5, 0.2, 0.0, 0.1, 0.05, tempo, -8.0, 210000)


def tracks(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def ids(rec):
    return [r.track_id for r in rec.rows.collect()]


def small(spark):
    return tracks(spark, row("seed", 0.9, 0.9), row("close", 0.85, 0.88, "b"), row("mid", 0.6, 0.5, "c", 60), row("far", 0.1, 0.1, "d", 95), row("hidden", 0.9, 0.9, "artist", 5), row("odd", 0.2, 0.9, "e", None))


def seed(spark):
    return small(spark).where("track_id = 'seed'")


PLAIN = Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False)


def test_similar_tracks_rank_first(spark):
    got = recommend(small(spark), seed(spark), 3, PLAIN)
    assert ids(got)[0] == "close" and ids(got)[-1] == "far" and set(ids(got)) == {"close", "mid", "far"} and got.pool_size == 3


def test_pool_rules(spark):
    cat = small(spark)
    assert set(ids(recommend(cat, seed(spark), 3, Policy("popularity", use_pca=False)))) == {"far", "close", "mid"}
    assert ids(recommend(cat, seed(spark), 2, Policy("popularity", use_pca=False))) == ["far", "close"]
    wide = recommend(cat, seed(spark), 4, PLAIN)
    assert wide.min_popularity is None and "hidden" in ids(wide) and "seed" not in ids(wide)
    assert "hidden" not in ids(recommend(cat, seed(spark), 4, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False, same_artist_exclusion=True)))
    assert "close" not in ids(recommend(cat, seed(spark), 4, PLAIN, exclude_ids=["close"]))
    none = recommend(cat.limit(0), seed(spark), 4, PLAIN)
    assert ids(none) == [] and none.pool_size == 0


def test_filters_follow_the_deployed_store(spark):
    cat = small(spark).union(tracks(spark, row(None, pop=90)))
    assert C.filter_candidates(cat, min_popularity=20).where("track_id is null").count() == 1
    assert C.filter_candidates(cat, ["x"], min_popularity=20).where("track_id is null").count() == 0
    assert C.filter_candidates(cat, max_popularity=70).select("track_id").collect() and C.filter_candidates(cat, year_range=(1990, 2000)).count() == 0
    assert [r.track_id for r in C.load_tracks(cat, ["mid", "nope", "close", "mid"]).collect()] == ["mid", "close"]
    with pytest.raises(CatalogError, match="nope"):
        C.load_seeds(cat, ["mid", "nope"])
    assert C.bounded_sample(cat, 3).count() == 3 and C.bounded_sample(cat, 3).collect() == C.bounded_sample(cat, 3).collect()


def test_steering_moves_and_neutral_steering_does_not(spark):
    cat = small(spark)
    base, none = recommend(cat, seed(spark), 5, PLAIN), recommend(cat, seed(spark), 5, PLAIN, {"energy": 0})
    assert [tuple(r) for r in base.rows.collect()] == [tuple(r) for r in none.rows.collect()]
    p = C.prepare(cat, seed(spark))
    by = {r.track_id: r for r in scored(p, seed(spark), PLAIN, {"energy": -0.5}).collect()}
    assert by["far"].similarity - by["far"].score == pytest.approx(0.2 * abs(0.1 - 0.55)) and by["close"].score < by["close"].similarity
    assert X.check_adjustments({"energy": 3, "valence": 0}) == {"energy": 0.5}
    for bad in ({"tempo": 0.1}, {"energy": float("nan")}):
        with pytest.raises(ValueError):
            X.check_adjustments(bad)


def test_random_and_randomised_results(spark):
    rng = np.random.default_rng(0)
    cat = tracks(spark, *[row(f"t{i}", float(rng.random()), float(rng.random())) for i in range(60)])
    s = cat.limit(1)
    a, b = (ids(recommend(cat, s, 5, Policy("random", use_pca=False, seed=x))) for x in (1, 1))
    assert a == b and len(set(a)) == 5 and a != ids(recommend(cat, s, 5, Policy("random", use_pca=False, seed=2)))
    top = ids(recommend(cat, s, 15, PLAIN))
    drawn = [ids(recommend(cat, s, 5, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False, randomize=True, seed=x))) for x in range(4)]
    assert all(set(d) <= set(top) and [top.index(x) for x in d] == sorted(top.index(x) for x in d) and len(d) == 5 for d in drawn) and len({tuple(d) for d in drawn}) > 1
    few = tracks(spark, *[row(f"t{i}", i / 10) for i in range(4)])
    assert len(ids(recommend(few, few.limit(1), 5, Policy(weights=DEFAULT_WEIGHTS, randomize=True, seed=1)))) == 3


def test_five_components_are_numpy(spark, sf):
    cat = S.catalog(spark, sf)
    seeds = cat.where("track_id in ('1', '2', '3')")
    p = C.prepare(cat, seeds)
    got = {r.track_id: r.similarity for r in scored(p, seeds, Policy("weighted_cosine", DEFAULT_WEIGHTS, pca_components=5)).collect()}
    cols = [f"t_{f}" for f in FEATURES]
    t = X.with_transformed(p.candidates).select("track_id", *cols).toPandas()
    m = t[cols].to_numpy(float)
    med = np.nan_to_num(np.nanmedian(m, 0))
    full = np.where(np.isnan(m), med, m)
    mean, sd = full.mean(0), full.std(0)
    sd = np.where(sd == 0, 1, sd)
    w = np.array([DEFAULT_WEIGHTS[f] for f in FEATURES])
    z = (full - mean) / sd * w
    s = X.with_transformed(seeds).select(*cols).toPandas().to_numpy(float)
    u = np.median((np.where(np.isnan(s), med, s) - mean) / sd, 0) * w
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    a, b = (z - z.mean(0)) @ vt[:5].T, vt[:5] @ (u - z.mean(0))
    want = a @ b / np.linalg.norm(a, axis=1) / np.linalg.norm(b)
    assert max(abs(got[i] - x) for i, x in zip(t.track_id, want)) < 1e-6
    with pytest.raises(ValueError):
        fit_pca(cat, [F.col("energy")], 0)


def test_features(spark):
    df = spark.createDataFrame([(500.0, 5.0, 2_400_000.0), (None, None, None), (float("nan"), -100.0, 1.0)], "tempo double, loudness double, duration_ms double")
    t = df.select(*[c.alias(f) for f, c in X.transformed(df, ("tempo", "loudness", "duration_ms")).items()]).collect()
    assert t[0].tempo == pytest.approx(np.log1p(300)) and t[0].loudness == 0 and t[0].duration_ms == pytest.approx(np.log1p(20)) and t[1].tempo is None and t[2].tempo is None and t[2].loudness == -60
    sec = spark.createDataFrame([(150.0,)], "duration double")
    assert sec.select(X.transformed(sec, ("duration_ms",))["duration_ms"].alias("x")).first().x == pytest.approx(np.log1p(2.5))
    with pytest.raises(ValueError):
        X.transformed(sec, ("energy",))
    const = spark.createDataFrame([(0.1, None)] * 7, "t_energy double, t_valence double")
    st = X.fit_scaler(const, ("energy", "valence")).first()
    assert (st.sd_energy, st.med_valence, st.mean_valence, st.sd_valence) == (1.0, 0.0, 0.0, 1.0)
    zero = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0)], "a double, b double, c double, d double")
    assert zero.select(X.cosine([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("x")).first().x == 0
    for bad in ({"nope": 1}, {"energy": -1}, {"energy": "x"}, {"energy": float("inf")}):
        with pytest.raises(ValueError):
            X.check_weights(bad)
    with pytest.raises(ValueError):
        X.profile(const, "mode")


def test_explanations(spark):
    names = ("energy", "valence", "acousticness", "tempo", "liveness")
    df = spark.createDataFrame([(0.0,) * 5 + (0.1, 0.0, 0.0, 5.0, 0.0)], ", ".join([f"p_{f} double" for f in names] + [f"z_{f} double" for f in names]))
    say = lambda feats, n=3: df.select(X.explanation(feats, n).alias("x")).first().x
    assert say(names) == "Recommended because it is similar to your playlist in valence, acousticness, and energy."
    assert say(names, 2).endswith("valence and acousticness.") and say(names, 1).endswith("in valence.") and "overall" in say(("liveness",))


def test_policies():
    with pytest.raises(TypeError):
        DEPLOYED.weights["energy"] = 1
    for bad in ({"strategy": "x"}, {"pca_components": 0}, {"year_range": (2, 1)}, {"weights": {"x": 1}}):
        with pytest.raises(ValueError):
            Policy(**bad)
    with pytest.raises(ValueError):
        BenchmarkConfig(confidence_level=1.0)
    assert len(DEFAULT_STRATEGIES) == 7 and len(with_tuned({"energy": 2.0})) == 9


# labels, metrics, benchmark


def test_memberships(spark):
    df = spark.createDataFrame([(" p ", "a"), ("p", "a"), ("p", None), ("p", " "), (None, "z")], "user string, track_id string")
    rows = L.normalize_memberships(df, "user").orderBy("position").collect()
    assert [(r.playlist_id, r.position, r.catalog_track_id, r.matched) for r in rows] == [("p", 0, "a", True), ("p", 2, None, False), ("p", 3, None, False)]
    with pytest.raises(KeyError):
        L.normalize_memberships(df)
    with pytest.raises(KeyError):
        L.normalize_memberships(df.drop("track_id"), "user")
    with pytest.raises(ValueError):
        L.filter_playlists(L.normalize_memberships(df, "user"), ["p", "q"])


def test_overlap_of_playlists(spark):
    rows = [("a", x) for x in "12345"] + [("b", x) for x in "12346"] + [("c", x) for x in "12345"] + [("d", "9"), ("e", None)]
    df = L.normalize_memberships(spark.createDataFrame(rows, "playlist_id string, track_id string"))
    got = sorted((r.a, r.b, r.shared) for r in L.pairwise_jaccard(df, 0.8).collect())
    assert got == [("a", "c", 5)] and len(L.pairwise_jaccard(df, 0.5).collect()) == 3 == len(L.pairwise_jaccard(df).collect())
    a = L.audit(df).first()
    assert (a.num_playlists, a.near_duplicate_pairs, a.max_pairwise_jaccard, a.benchmark_ready) == (5, 1, 1.0, False) and len(L.audit_warnings(a)) == 2
    assert L.audit(df.where("playlist_id in ('a', 'd')")).first().max_pairwise_jaccard == 0
    low = df.where("playlist_id = 'a' or source_track_id = '6'")
    assert L.audit(low).first().max_pairwise_jaccard == 0 and L.audit(df.where("playlist_id = 'a' or source_track_id in ('4', '6')")).first().max_pairwise_jaccard == 0.5
    assert L.audit(df.limit(0)).first().num_playlists == 0


def test_labels_by_any_of_their_names(spark, tmp_path):
    both = spark.createDataFrame([("p", 0, "a", "a"), ("p", 1, "b", None)], "playlist_id string, position int, source_spotify_id string, catalog_spotify_id string")
    rows = L.normalize_memberships(both).orderBy("position").collect()
    assert [(r.source_track_id, r.catalog_track_id, r.matched) for r in rows] == [("a", "a", True), ("b", None, False)]
    assert L.label_facts(both) == {"schema": "membership-v2", "preserves_unmatched": True}
    old = spark.createDataFrame([("p", "a")], "playlist_id string, spotify_id string")
    assert L.normalize_memberships(old).first().catalog_track_id == "a" and L.label_facts(old) == {"schema": "legacy-matched-only", "preserves_unmatched": False}
    again = L.normalize_memberships(L.normalize_memberships(both))
    assert again.count() == 2


def test_one_playlist_is_split(spark):
    df = spark.createDataFrame([("p", f"t{i % 7}") for i in range(9)] + [("p", None)], "playlist_id string, catalog_track_id string")
    seeds, rest = R.split_tracks(df, 3, 1)
    own = {r.catalog_track_id for r in seeds.collect()}
    assert len(own) == 3 == seeds.count() and rest == {f"t{i}" for i in range(7)} - own and R.split_tracks(df, 3, 1)[1] == rest
    with pytest.raises(ValueError):
        R.split_tracks(df, 7)


def test_wide_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 999, 60_000):
        a = rng.random(n)
        b = np.where(rng.random(n) < 0.5, 1.0, rng.integers(0, 3, n).astype(float))  # a value that most rows share
        rows = [(float(x), float(y), None if i % 3 else float(x)) for i, (x, y) in enumerate(zip(a, b))]
        got = X.wide_medians(spark.createDataFrame(rows, "a double, b double, c double"), {"x": "a", "y": "b", "z": "c"}).first()
        want = [float(np.median(v)) if len(v) else None for v in (a, b, a[::3])]
        assert [got.x, got.y, got.z] == [pytest.approx(w) if w is not None else None for w in want], n


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("z", 1, "a")], "r string, rank int, track_id string")
    rel = spark.createDataFrame([("q", "a"), ("q", "b")], "r string, track_id string")
    req = spark.createDataFrame([("q", 2), ("z", 0), ("n", 4)], "r string, relevant_count long")
    got = {r.r: r for r in K.ranking_metrics(K.marked_hits(recs, rel, ["r"], 3), req, ["r"], 3).collect()}
    assert got["q"].precision_at_k == pytest.approx(2 / 3) and got["q"].recall_at_k == 1 and got["q"].ndcg_at_k == pytest.approx((1 + 0.5) / (1 + 1 / np.log2(3)))
    assert got["z"].ndcg_at_k == 0 and got["n"].recall_at_k == 0 and got["n"].hit_rate_at_k == 0


def test_bootstrap_is_deterministic_and_skips_missing_values(spark):
    df = spark.createDataFrame([("s", str(i), float(i), None) for i in range(20)] + [("s", "x", float("nan"), None)], "strategy string, playlist_id string, m double, n double")
    a, b = (K.bootstrap(df, ("m", "n"), 200, 0.9, 1).collect() for _ in range(2))
    assert a == b and len(a) == 1 and a[0].ci_low < a[0].mean == 9.5 < a[0].ci_high


def test_exposure_keeps_silent_strategies(spark):
    recs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "strategy string, track_id string")
    rows = {r.strategy: r for r in K.exposure(recs, spark.createDataFrame([("a",), ("b",)], "strategy string"), 4).collect()}
    assert rows["a"].catalog_coverage == 0.5 and rows["a"].recommendation_repeat_rate == pytest.approx(1 / 3) and rows["b"].unique_recommendations == 0 == rows["b"].recommendation_repeat_rate


def playlists(spark, n=8, size=9):
    rows = [(f"p{i}", f"t{(i * 3 + j) % 40}") for i in range(n) for j in range(size)] + [("small", "t1"), ("p0", "gone")]
    df = spark.createDataFrame(rows, "playlist_id string, track_id string")
    return df.select("playlist_id", F.col("track_id").alias("source_track_id"), F.when(F.col("track_id") != "gone", F.col("track_id")).alias("catalog_track_id"))


def big(spark):
    rng = np.random.default_rng(1)
    return tracks(spark, *[row(f"t{i}", float(rng.random()), float(rng.random()), f"a{i % 7}", int(rng.integers(0, 100)), tempo=None if i % 9 == 0 else float(60 + i)) for i in range(40)])


def test_benchmark_end_to_end(spark, tmp_path):
    cfg = BenchmarkConfig(num_splits=2, bootstrap_samples=20, top_k=5, min_playlists_for_claim=3)
    res = B.evaluate(big(spark), playlists(spark), cfg)
    per = res.per_split.collect()
    assert len(per) == 8 * 2 * 7 and res.skipped.count() == 2 and {r.strategy for r in res.summary.collect()} == {s.name for s in DEFAULT_STRATEGIES}
    for r in per:
        assert 0 <= r.recall_at_k <= r.candidate_recall_ceiling <= r.matched_recall_ceiling <= 1 and r.fill_rate <= 1
        assert (r.steering_target_distance is None) == (not r.strategy.startswith("weighted_cosine_pca")) and (r.avg_similarity is None) == (r.strategy in ("random", "popularity"))
    assert min(r.matched_recall_ceiling for r in per if r.playlist_id == "p0") < 1
    assert [tuple(r) for r in B.evaluate(big(spark), playlists(spark), cfg).summary.collect()] == [tuple(r) for r in res.summary.collect()]
    data = P.payload(res, cfg, DEFAULT_STRATEGIES)
    assert data["num_skipped"] == res.skipped.count() == len(data["skipped"]) and data["generated_at_utc"].endswith("+00:00") and all(s["description"] for s in data["strategies"])
    assert data["status"] == "benchmark" and json.loads(json.dumps(data, allow_nan=False))
    text = P.render(data)
    assert "| weighted_cosine |" in text and "95% CI" in text
    readme = tmp_path / "R.md"
    readme.write_text(f"before\n{P.BEGIN}\nold\n{P.END}\nafter\n")
    P.update_readme(str(readme), data, "r.md")
    assert "old" not in readme.read_text() and readme.read_text().startswith("before\n") and readme.read_text().endswith("after\n")
    (tmp_path / "x.md").write_text("no markers")
    with pytest.raises(ValueError):
        P.update_readme(str(tmp_path / "x.md"), data, "r.md")
    assert P.comparison_table([], 5) == "No request could be evaluated."


def test_batch_and_single_requests_agree(spark):
    cat, cfg = big(spark), BenchmarkConfig(num_splits=1, top_k=5)
    asked, _ = R.requests(L.normalize_memberships(playlists(spark)), 5, 1, 0)
    strategies = [Strategy("w", PLAIN), Strategy("p5", Policy("weighted_cosine", DEFAULT_WEIGHTS), {"energy": 0.3}), Strategy("x", Policy("popularity", use_pca=False))]
    batch = B.score_requests(asked, cat, strategies, cfg).collect()
    q = asked.orderBy("playlist_id").first()
    seeds = C.load_seeds(cat, q.seeds)
    for s in strategies:
        one = recommend(cat, seeds, 5, s.policy, s.adjustments).rows.collect()
        many = sorted((r for r in batch if r.playlist_id == q.playlist_id and r.strategy == s.name), key=lambda r: r.rank)
        assert [r.track_id for r in one] == [r.track_id for r in many] and [r.score for r in one] == pytest.approx([r.score for r in many], abs=1e-8)


def test_blocks_of_requests_are_brute_force(spark):
    """All seven strategies with five components, missing values and repeated ids, one request at a time in numpy."""
    from crossfade.schema import STEERABLE

    cat = big(spark).withColumn("loudness", F.when(F.col("track_id") != "t3", F.col("loudness"))).cache()
    cat = cat.union(cat.where("track_id in ('t5', 't11')").withColumn("energy", F.lit(0.9)))
    cfg = BenchmarkConfig(num_splits=2, top_k=6, candidate_limit=30)
    asked, _ = R.requests(L.normalize_memberships(playlists(spark)), 5, 2, 0)
    found = {}
    for r in B.score_requests(asked, cat, DEFAULT_STRATEGIES, cfg).collect():
        found.setdefault((r.playlist_id, r.split_id, r.strategy), []).append(r)
    first, wide = B._pools(cat, cfg)
    assert first.repeats or wide is not None
    seeds = {r.track_id: r for r in B._shaped(cat).orderBy(F.desc("t"), F.desc("r")).collect()}
    for q in asked.collect():
        pool = first
        gone = set(pool.gone(set(q.seeds), None, cfg.candidate_limit).tolist())
        if pool.size - len(gone) < cfg.top_k:
            pool = wide
            gone = set(pool.gone(set(q.seeds), None, cfg.candidate_limit).tolist())
        keep = np.array([i for i in range(pool.size) if i not in gone])
        assert len(keep) <= 30
        fitted = B._fit(pool.t[keep])
        z = B._scale(pool.t[keep], fitted)
        own = B._scale(np.array([[np.nan if x is None else x for x in seeds[i].t] for i in q.seeds], float), fitted)
        profile = np.median(own, axis=0)
        for s in DEFAULT_STRATEGIES:
            rows = sorted(found[q.playlist_id, q.split_id, s.name], key=lambda r: r.rank)
            assert [r.rank for r in rows] == list(range(1, 7)) and rows[0].candidate_pool_size == len(keep)
            if s.policy.strategy in ("popularity", "random") or s.name == "deployed":
                assert {r.track_id for r in rows} <= {pool.ids[int(i)].as_py() for i in keep}
                continue
            w = np.array([(s.policy.weights or {}).get(f, 1.0) for f in FEATURES]) if s.policy.strategy == "weighted_cosine" else np.ones(len(FEATURES))
            u, v = profile * w, z * w
            if s.policy.use_pca:
                mean = v.mean(0)
                axes = np.linalg.svd(v - mean, full_matrices=False)[2][:5]
                u, v = axes @ (u - mean), (v - mean) @ axes.T
            score = np.round(v @ u / (np.linalg.norm(u) * np.linalg.norm(v, axis=1)), 9)
            for f, d in (s.adjustments or {}).items():
                j = STEERABLE.index(f)
                base = np.median([seeds[i].r[j] for i in q.seeds])
                score = score - 0.2 * np.abs(pool.r[keep, j] - min(1, max(0, base + d * 0.7)))
            assert [r.score for r in rows] == pytest.approx(sorted(score, reverse=True)[:6], abs=1e-7), s.name


def test_batch_falls_back_and_excludes_artists(spark):
    asked, _ = R.requests(L.normalize_memberships(playlists(spark)), 5, 1, 0)
    high = B.score_requests(asked, big(spark), [Strategy("w", PLAIN)], BenchmarkConfig(num_splits=1, min_popularity=101, top_k=5)).collect()
    assert {r.candidate_pool_size for r in high} == {35}
    apart = B.score_requests(asked, big(spark), [Strategy("w", PLAIN)], BenchmarkConfig(num_splits=1, min_popularity=None, same_artist_exclusion=True, fit_on="catalog")).collect()
    artists = {r.track_id: r.artist_primary_canon for r in big(spark).collect()}
    own = {r.playlist_id: {artists[i] for i in r.seeds} for r in asked.collect()}
    assert all(r.artist_primary_canon not in own[r.playlist_id] for r in apart)


def test_tuning_never_sees_held_out_playlists(spark):
    cfg = B.TuningConfig(num_trials=4, benchmark=BenchmarkConfig(num_splits=1, bootstrap_samples=5, top_k=5))
    a, b = (B.tune(big(spark), playlists(spark), cfg) for _ in range(2))
    assert a.to_json() == b.to_json() and a.selected in {"uniform", "hand_set_defaults", "random_001", "random_002"}
    data = json.loads(a.to_json())
    assert set(data["partition"]["test_playlist_ids"]) & set(data["partition"]["tuning_playlist_ids"]) == set() and len(data["partition"]["test_playlist_ids"]) == 2
    assert all(0.25 <= w <= 4 for _, ws, s in R.log_uniform_weights(4, FEATURES, 0.25, 4) if s != "baseline" for w in ws.values())
    with pytest.raises(ValueError):
        B.tune(big(spark), playlists(spark, 1), cfg)


def test_playlist_requests(spark):
    cat = big(spark)
    items = spark.createDataFrame([("p", 0, "t1", "x", ["y"], None), ("p", 1, None, "Track t2", ["a2"], None)], "playlist_id string, position long, source_track_id string, title string, artists array<string>, duration_ms long")
    seen = spark.createDataFrame([("t3",)], "track_id string")
    got = ids(recommend_for_playlist(cat, items, 30, PLAIN, seen=seen))
    assert got and not {"t1", "t2", "t3"} & set(got)
    with pytest.raises(NoMatchesError):
        recommend_for_playlist(cat, items.limit(0), 5, PLAIN)
    shown = serve(cat, items, lambda i: [f"{i}/large", f"{i}/small"], 3, policy=PLAIN).rows.collect()
    assert [r.album_art_url for r in shown] == [f"{r.track_id}/small" for r in shown] and [r["rank"] for r in shown] == [1, 2, 3]
    from crossfade.sources.sinks import send_playlist

    sent = []
    rows = spark.range(1, 251).select(F.col("id").alias("rank"), F.concat(F.lit("t"), "id").alias("track_id")).union(spark.createDataFrame([(999, None)], "rank long, track_id string"))
    assert send_playlist(rows, lambda: "new", lambda p, uris: sent.append((p, uris))) == "new"
    assert [len(u) for _, u in sent] == [100, 100, 50] and [u for _, us in sent for u in us] == [f"track:t{i}" for i in range(1, 251)]
    with pytest.raises(NoMatchesError):
        send_playlist(rows.limit(0), lambda: "new", lambda p, uris: None)


def test_only_rows_that_may_be_given_are_scored(monkeypatch):
    """Of 4,000 candidates few are scored for a request, and the best ones are those of scoring all."""
    import numpy as np
    import pyarrow as pa

    from crossfade.schema import FEATURES, STEERABLE

    rng = np.random.default_rng(3)
    t = rng.normal(size=(4000, len(FEATURES)))
    t[rng.random(t.shape) < 0.03] = np.nan
    t[100:110] = t[100]  # ties
    rows = [{"track_id": f"t{i:05d}", "artist_primary_canon": f"a{i % 50}", "popularity": float(i % 90), "t": list(x), "r": list(rng.random(len(STEERABLE)))} for i, x in enumerate(np.where(np.isnan(t), None, t).tolist())]
    kind = pa.schema([("track_id", pa.string()), ("artist_primary_canon", pa.string()), ("popularity", pa.float64()), ("t", pa.list_(pa.float64())), ("r", pa.list_(pa.float64()))])
    pool = B.Pool(pa.Table.from_pylist(rows, kind))
    seen = []
    plain = B._Measure.similarity
    monkeypatch.setattr(B._Measure, "similarity", lambda self, pool, rows: (seen.append(len(rows)), plain(self, pool, rows))[1])
    for components in (None, 3, len(FEATURES)):
        cfg = BenchmarkConfig(num_splits=1, pca_components=components or 5)
        weights = {f: 0.5 + 0.1 * i for i, f in enumerate(FEATURES)}
        strategy = Strategy("s", Policy("weighted_cosine", weights, use_pca=components is not None), {"energy": 0.3})
        asked = [B._prepared({"playlist_id": str(p), "split_id": 0, "seeds": [{"track_id": rows[i]["track_id"], "artist": "x", "t": rows[i]["t"], "r": rows[i]["r"]} for i in range(p, p + 5)], "positives": [], "num_positives": 0}, pool, None, None, cfg)[1] for p in (0, 98, 700)]
        bounds, measures = B._bounds(pool, asked, B._kind(strategy, cfg), None)
        for q, bound, measure in zip(asked, bounds, measures):
            free = np.delete(np.arange(pool.size), q.gone)
            sim = plain(measure, pool, free)
            assert (bound[free] >= sim).all()
            own = np.median(q.seeds_r[:, 0])
            score = np.round(np.round(sim, 9) - 0.2 * np.abs(pool.r[free, 0] - min(1.0, own + 0.3 * 0.7)), 9)
            want = free[np.lexsort((pool.by_id[free], -score))[:10]]
            seen.clear()
            got, _, _ = B._choose(pool, q, strategy, bound, measure, cfg)
            assert got.tolist() == want.tolist() and sum(seen) < pool.size / 4


def test_requests_read_and_deal_their_labels_once(spark):
    """F16, F17, F22: labels were derived four times over, and each split's copies were shuffled."""
    from crossfade.operators import rank as R

    odd = [("p", f"t{i}", True) for i in range(6)] + [("p", "t0", True), ("p", "t1", False), ("p", None, False), ("p", None, False)]
    odd += [("few", "t1", True), ("few", None, False), ("none", None, False), ("all", "a", True), ("all", "b", True), ("all", "a", True), (None, "a", True), (None, "b", True), (None, "c", True)]
    labels = spark.createDataFrame(odd, "playlist_id string, catalog_track_id string, matched boolean")
    places = R.seed_split(labels, 2, 2, 0).where("playlist_id is not null").collect()
    asked, skipped = R.requests(labels, 2, 2, 0)
    want = {}
    for split in range(2):
        ordered = [r.catalog_track_id for r in sorted((r for r in places if (r.playlist_id, r.split_id) == ("p", split)), key=lambda r: r.place)]
        seeds = ordered[:2]
        taken = sum(1 for p, t, m in odd if p == "p" and m and t in seeds)
        want["p", split] = (seeds, sorted(ordered[2:]), 10 - taken)
    assert {(r.playlist_id, r.split_id): (r.seeds, r.positives, r.num_positives) for r in asked.collect()} == want
    assert {(r.playlist_id, r.split_id, r.reason.split()[0]) for r in skipped.collect()} == {(p, s, w) for s in range(2) for p, w in (("few", "too"), ("none", "too"), ("all", "nothing"))}
    for rows in (R.seed_split(labels, 2, 2, 0), asked, skipped):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange ") == 1 and plan.count("Scan ") == 1, plan


def test_medians_of_groups_shuffle_rows_not_maps(spark):
    """each row went through the shuffle as ten maps of one value."""
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 3.0), ("a", None), (None, 2.0)], "g string, z_energy double")
    out = X.profile(df, "median", ["energy"], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_percentile") < plan.index("Exchange ") and plan.count("Exchange ") == 1, plan
    assert {(r.g, r.p_energy) for r in out.collect()} == {("a", 2.5), ("b", 3.0), (None, 2.0)}


def test_no_candidate_is_left_out_of_the_benchmark(spark, sf, monkeypatch):
    """with more tracks than ``candidate_limit`` the queries sampled them, which the SQL doesn't."""
    from crossfade.plans import policy as P
    from crossfade.plans import queries as Q
    from crossfade.sources import fixtures as S

    seen = []
    plain = B._pools
    monkeypatch.setattr(B, "_pools", lambda catalog, cfg: (seen.append((cfg.candidate_limit, plain(catalog, cfg))), seen[-1][1])[1])
    Q.benchmark_summary(spark, sf)
    Q.benchmark_per_split(spark, sf)
    eligible = S.catalog(spark, sf).where("coalesce(popularity, 0) >= 20").count()
    assert [(limit, first.size) for limit, (first, _) in seen] == [(None, eligible)] * 2
    assert P.BenchmarkConfig().candidate_limit == 100_000


def test_few_cells_of_a_large_pool_are_looked_into():
    """a request looks at the rows of some cells, and finds what scoring all rows finds."""
    import pyarrow as pa

    from crossfade.schema import FEATURES, STEERABLE

    rng = np.random.default_rng(5)
    n = 60_000
    t = np.repeat(rng.normal(size=(n // 4, len(FEATURES))), 4, axis=0)
    rows = pa.table({"track_id": [f"t{i % (n - 7):05d}" for i in range(n)], "artist_primary_canon": [f"a{i % 50}" if i % 9 else None for i in range(n)], "popularity": pa.array(np.arange(n) % 90.0), "t": t.tolist(), "r": rng.random((n, len(STEERABLE))).tolist()})
    pool, cfg = B.Pool(rows), BenchmarkConfig(num_splits=1, candidate_limit=None)
    assert pool.repeats and pool.find(["t00003", "t59990", "none"]) == [[3, n - 4], [59990], []]
    assert pool.gone({"t00003"}, {"a1"}, None).tolist() == sorted({3, n - 4} | {i for i in range(n) if not i % 9 or i % 50 == 1})
    q = B._prepared({"playlist_id": "p", "split_id": 0, "seeds": [{"track_id": f"t{i:05d}", "artist": "x", "t": t[i].tolist(), "r": [0.5] * 4} for i in range(5)], "positives": ["t00009"], "num_positives": 1}, pool, None, None, cfg)[1]
    assert np.allclose(pool.fit(q.gone), B._fit(np.delete(pool.t, q.gone, 0)))
    for strategy in DEFAULT_STRATEGIES[2:5]:
        (bound,), (measure,) = B._bounds(pool, [q], B._kind(strategy, cfg), None)
        looked, plain = [], bound.rows
        bound.rows = lambda cells, least: (looked.append(len(cells)), plain(cells, least))[1]
        got, _, _ = B._choose(pool, q, strategy, bound, measure, cfg)
        free = np.delete(np.arange(n), q.gone)
        sim = np.round(measure.similarity(pool, free), 9)
        assert got.tolist() == free[np.lexsort((pool.by_id[free], -sim))[:10]].tolist() and sum(looked) < len(bound.cells) * 0.9
