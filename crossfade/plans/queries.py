"""Queries over the derived fixtures: one per operator, rounded and aliased for comparison with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import text as T
from ..operators import labels as L
from ..operators import match as M
from ..operators import merge as G
from ..operators import metrics as K
from ..operators import rank as R
from ..operators import retrieve as C
from ..operators.pca import fit_pca
from ..schema import DEFAULT_WEIGHTS, DEPLOYED_TYPES, FEATURES
from ..sources import fixtures as S
from ..streaming import exposure as E
from . import benchmark as B
from .policy import DEFAULT_STRATEGIES, BenchmarkConfig, Policy
from .recommend import recommend, recommend_prepared, scored

USER = "7"  # the playlist of the single-request queries
SEED = 0
SPLITS = 2
TOP = 10
AXES = len(FEATURES)  # of the benchmark's principal components: with all of them SQL can follow every strategy
STEER = {"energy": 0.25, "valence": -0.3}


def r6(c: Column | str) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _named(df: DataFrame, *keep: str, **rounded: Column | str) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(k) for k, c in rounded.items()])


# scans, projections and filters


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    return _named(S.catalog(spark, d), "track_id", "title_raw", "title_canon", "artist_primary_canon", "popularity", "release_year", "duration_ms", **{f: f for f in FEATURES if f != "duration_ms"})


def typed_projection(spark, d):
    wide = S.catalog(spark, d).select(*[F.col(c).cast(t).alias(c) for c, t in DEPLOYED_TYPES.items()])
    return _named(wide, "track_id", "release_year", "duration_ms", **{c: F.col(c).cast("double") for c in ("popularity", "energy", "tempo", "loudness")})


def _filtered(spark, d, **kw):
    return C.filter_candidates(S.catalog(spark, d), ["1", "2", "", "1"], ["brand#7", "brand#12"], **kw)


def filter_candidates(spark, d):
    return _filtered(spark, d, min_popularity=20, max_popularity=90, year_range=(1970, 2010)).select("track_id", "popularity", "release_year", "artist_primary_canon")


def count_candidates(spark, d):
    return _filtered(spark, d, min_popularity=20).agg(F.count("*").alias("eligible"))


def bounded_sample(spark, d):
    return C.bounded_sample(C.filter_candidates(S.catalog(spark, d), min_popularity=20), 100, SEED).select("track_id")


def load_tracks_ordered(spark, d):
    ids = ["9", "4", "no such track", "9", "11"]
    return C.load_tracks(S.catalog(spark, d), ids).select("track_id", "title_raw")


def point_lookup(spark, d):
    return C.lookup(S.catalog(spark, d), "11").select("track_id", "title_raw", "artist_primary_canon")


def fallback_candidates(spark, d):
    p = C.prepare(*_request(spark, d), TOP, min_popularity=101)
    _KEPT.append(p.candidates)
    return p.candidates.select("track_id", F.lit(p.min_popularity is None).alias("bound_dropped"))


def exclude_same_artist(spark, d):
    p = C.prepare(*_request(spark, d), TOP, same_artist_exclusion=True)
    _KEPT.append(p.candidates)
    return p.candidates.select("track_id", "artist_primary_canon")


def seen_exclusion(spark, d):
    """Eligible tracks that no event of the user has shown: an unbounded list, anti-joined as a table."""
    seen = S.table(spark, d, "events").where(F.col("event_type") == "view").select((F.col("user_id") * 3).cast("string").alias("track_id")).distinct()
    return C.filter_candidates(S.catalog(spark, d), min_popularity=20).join(seen, "track_id", "left_anti").select("track_id")


# text


def canon_title(spark, d):
    return S.playlist_items(spark, d).select("title").distinct().select("title", T.canon_title(F.col("title")).alias("canon"))


EDGE_TITLES = (
    "Cafe del Mar - Radio Edit", "Café  del Mar", "Halo (Remastered 2011)", "Sweetest Thing!!!", "Twenty-One - Live", "Song (Live) (feat. X)",
    "Song (feat. X) [Live]", "A {acoustic}  (clean)", " - live", "livewire (alive)", "", "Ünïcode – Live",
)


def _formed(spark, d, name: str, key: str, fill: str, column: str, forms) -> DataFrame:
    """A table's rows with a text each: by its key one of ``forms``, filled with another column."""
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col(key) % len(forms)).cast("int"))
    return S.table(spark, d, name).select(key, F.col(fill), F.replace(form, F.lit("{}"), F.col(fill).cast("string")).alias(column))


def canon_title_edges(spark, d):
    return _formed(spark, d, "part", "p_partkey", "p_name", "title", EDGE_TITLES).select("p_partkey", "title", T.canon_title(F.col("title")).alias("canon"))


#: Names, their canonical form as one name, and as a text of several.
ARTIST_NAMES = (
    ("{}", "{}", "{}"), ("  The   {} ", "the {}", "the {}"), ("{} é Björk", "{} e bjork", "{} e bjork"), ("{}, The Creator", "{}, the creator", "{}"),
    ("AC/{}", "ac/{}", "ac/{}"), ("['{}', 'X']", "['{}', 'x']", "{}"), ("", "", ""), ("ﬁ{}½", "fi{}12", "fi{}12"),
)


def canon_artist(spark, d):
    names = _formed(spark, d, "part", "p_partkey", "p_brand", "name", [n for n, *_ in ARTIST_NAMES])
    return names.select("p_partkey", "name", T.canon_artist(F.array("name")).alias("as_name"), T.canon_artist_text(F.col("name")).alias("as_text"))


#: Artist fields, the names in them as a list where some names have commas, and as one name.
ARTIST_FIELDS = (
    ("{}, The Creator, Kali Uchis", "{}, The Creator|Kali Uchis", "{}, The Creator, Kali Uchis"), ("Solo {}", "Solo {}", "Solo {}"), (" A , {} ,, C", "A|{}|C", "A , {} ,, C"), ("['X', ' {} ']", "X|{}", "X|{}"),
    ("Earth, Wind, {}", "Earth, Wind, {}", "Earth, Wind, {}"), ("", "", ""), ("{}, Earth, Wind, {}, Water", "{}|Earth, Wind, {}|Water", "{}, Earth, Wind, {}, Water"), ("Crosby, {}", "Crosby|{}", "Crosby, {}"),
)


def parse_artists(spark, d):
    """Fields of several artists, with names that have commas known from a column of single names."""
    brand = F.col("p_brand")
    single = F.explode(F.array(F.concat(brand, F.lit(", The Creator")), F.concat(F.lit("Earth, Wind, "), brand), F.lit("Earth, Wind")))
    known = G.known_names([S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), single.alias("artist_name"))])
    rows, names = G.with_known(G.dealt(_formed(spark, d, "part", "p_partkey", "p_brand", "artist_names", [f for f, *_ in ARTIST_FIELDS])), known)
    field = F.col("artist_names")
    return rows.select("p_partkey", field.alias("field"), F.array_join(T.parse_artists(field, "artist_names", names), "|").alias("many"), F.array_join(T.parse_artists(field, "artist_name"), "|").alias("one"))


BOOLEANS = ("True", " yes ", "1", "0", "FALSE", "no", "maybe", "", "1.0", "{}")


def parse_bool(spark, d):
    return _formed(spark, d, "orders", "o_orderkey", "o_orderstatus", "v", BOOLEANS).select("o_orderkey", "v", T.parse_bool(F.col("v")).alias("b"))


PLAYLIST_REFERENCES = ("https://open.example/playlist/AbC{}?si=x", "service:playlist:Zz{}", "37i9dQ{}", "not playlist {}!", "https://x/playlist/", " {}Q ")


def playlist_id_extract(spark, d):
    return _formed(spark, d, "customer", "c_custkey", "c_nationkey", "v", PLAYLIST_REFERENCES).select("c_custkey", "v", T.playlist_id(F.col("v")).alias("id"))


def artist_display(spark, d):
    return S.playlist_items(spark, d).select("artists").distinct().select(F.get("artists", 0).alias("first"), T.artist_display(F.col("artists")).alias("shown"), T.artist_display(F.array(F.lit(" "))).alias("unknown"))


def track_uris(spark, d):
    return S.playlist_items(spark, d).select(T.track_uri(F.col("source_track_id")).alias("uri")).where("uri is not null").distinct()


def setting_scale(spark, d):
    """Quantities as settings of a slider, beyond both of its ends too."""
    rows = S.table(spark, d, "lineitem").select(((F.col("l_quantity") - 2) / 4).alias("setting")).distinct()
    return rows.select("setting", r6(T.setting_to_adjustment(F.col("setting"))).alias("shift"))


def source_identity(spark, d):
    rows = M.identify(S.playlist_items(spark, d))
    kind = F.substring("item_key", 1, 1)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("item_key").alias("n_keys"))


# merge


def normalize_rows(spark, d):
    return _merged(G.union_normalized(S.raw_tables(spark, d)))


def known_comma_artists(spark, d):
    named = S.table(spark, d, "part").select(F.concat("p_brand", F.lit(", The "), "p_type").alias("artist_name"), F.lit("x").alias("id"))
    return G.known_names([named]).select(F.replace("key", F.lit("\x1f"), F.lit("|")).alias("key"), "name")


def _merged(rows: DataFrame) -> DataFrame:
    keep = ("track_id", "title_raw", "title_canon", "artist_primary_canon", "duration_ms", "explicit", "popularity", "release_year", "isrc", "album")
    return rows.select(*keep, F.array_join("artists_raw", "|").alias("artists"), r6("energy").alias("energy"), r6("valence").alias("valence"), r6("tempo").alias("tempo"))


def dedupe_by_id(spark, d):
    """Durations that lie apart are folded by ranges of rows."""
    return _merged(G.merge_by_id(G.union_normalized(S.raw_tables(spark, d)), ranged=True))


def dedupe_by_isrc(spark, d):
    return _merged(G.merge_by_isrc(G.union_normalized(S.raw_tables(spark, d))))


def dedupe_by_canon_duration(spark, d):
    return _merged(G.merge_by_canon(G.union_normalized(S.raw_tables(spark, d))))


def merge_three_pass(spark, d):
    return _merged(G.merge_tables(S.raw_tables(spark, d)))


def duplicate_reduction(spark, d):
    rows = G.union_normalized(S.raw_tables(spark, d))
    a, b = rows.agg(F.count("*").alias("raw_rows")), G.merge_by_id(rows).agg(F.count("*").alias("merged_rows"))
    return a.crossJoin(b).select("raw_rows", "merged_rows", r6(G.reduction_rate(F.col("raw_rows"), F.col("merged_rows"))).alias("rate"))


# matching and labels


def _items(spark, d) -> DataFrame:
    return M.first_occurrences(M.identify(S.playlist_items(spark, d)))


def match_by_id(spark, d):
    return M.match_by_id(_items(spark, d), S.catalog(spark, d)).select("playlist_id", "position", "source_track_id", "catalog_track_id")


def match_by_metadata(spark, d):
    return M.matches_of_items(_items(spark, d), S.catalog(spark, d)).select("playlist_id", "position", "catalog_track_id")


def match_best(spark, d):
    return M.match_items(_items(spark, d), S.catalog(spark, d)).select("playlist_id", "position", "catalog_track_id", "matched")


def membership_labels(spark, d):
    return M.playlist_labels(S.playlist_items(spark, d), S.catalog(spark, d))


def match_summary(spark, d):
    items = S.playlist_items(spark, d)
    out = M.match_summary(items, M.playlist_labels(items, S.catalog(spark, d)))
    return out.withColumn("match_rate", r6("match_rate"))


def label_builder(spark, d):
    labels, _ = M.build_labels(S.playlist_items(spark, d), S.catalog(spark, d), 20)
    return labels.select("playlist_id", "position", "catalog_track_id", "matched")


def match_rollup(spark, d):
    out = M.rollup_labels(M.playlist_labels(S.playlist_items(spark, d), S.catalog(spark, d)))
    return out.withColumn("match_rate", r6("match_rate"))


def playlist_profile_rows(spark, d):
    return M.playlist_profile(S.playlist_items(spark, d), S.catalog(spark, d)).groupBy("playlist_id").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("n_tracks"))


def normalize_memberships(spark, d):
    old = S.occurrences(spark, d).select(F.concat(F.lit(" "), "playlist_id").alias("user"), "position", F.col("part").cast("string").alias("track_id"))
    return L.normalize_memberships(old, "user", "position").select("playlist_id", "position", "source_track_id", "catalog_track_id", "matched")


def membership_audit(spark, d):
    out = L.audit(S.memberships(spark, d))
    return out.withColumns({c: r6(c) for c in ("match_rate", "max_pairwise_jaccard", "median_playlist_size")})


def pairwise_jaccard(spark, d):
    return L.pairwise_jaccard(S.memberships(spark, d), 0.1).select("a", "b", "shared", r6("jaccard").alias("jaccard"))


# features


def special_transforms(spark, d):
    return _named(X.with_transformed(S.catalog(spark, d)), "track_id", **{f: f"t_{f}" for f in ("tempo", "loudness", "duration_ms")})


_KEPT: list[DataFrame] = []


def _kept(df: DataFrame) -> DataFrame:
    """A derived table that one query reads several times, kept until the next query keeps one."""
    while _KEPT:
        _KEPT.pop().unpersist()
    _KEPT.append(df.persist())
    return df


def _transformed(spark, d) -> DataFrame:
    """The derived catalog, kept: medians, moments and rows all read it."""
    return X.with_transformed(_kept(S.catalog(spark, d)))


def scaler_stats(spark, d):
    stats = X.fit_scaler(_transformed(spark, d))
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), r6(f"med_{f}").alias("median"), r6(f"mean_{f}").alias("mean"), r6(f"sd_{f}").alias("sd")) for f in FEATURES]))
    return stats.select(rows)


def impute_medians(spark, d):
    t = _transformed(spark, d)
    return _named(t.crossJoin(F.broadcast(X.fit_scaler(t))), "track_id", tempo=F.coalesce("t_tempo", "med_tempo"), loudness=F.coalesce("t_loudness", "med_loudness"))


def _scaled(spark, d) -> DataFrame:
    t = _transformed(spark, d)
    return X.with_scaled(t, X.fit_scaler(t))


def scaled_features(spark, d):
    return _named(_scaled(spark, d), "track_id", **{f: f"z_{f}" for f in FEATURES})


def weighted_features(spark, d):
    return _named(_scaled(spark, d), "track_id", **{f: F.col(f"z_{f}") * DEFAULT_WEIGHTS[f] for f in FEATURES})


def _profiles(spark, d, method) -> DataFrame:
    """The taste of every playlist at once."""
    labels = S.memberships(spark, d).where("matched").select("playlist_id", F.col("catalog_track_id").alias("track_id"))
    return _named(X.profile(labels.join(_scaled(spark, d), "track_id"), method, by=["playlist_id"]), "playlist_id", **{f: f"p_{f}" for f in FEATURES})


def profile_median(spark, d):
    return _profiles(spark, d, "median")


def profile_mean(spark, d):
    return _profiles(spark, d, "mean")


# one request


def _request(spark, d, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalog and the five seeds of the user; the pool, the fits and the scores all read them."""
    catalog = _kept(S.catalog(spark, d, in_order))
    ids = S.memberships(spark, d).where((F.col("playlist_id") == USER) & F.col("matched")).orderBy("position").limit(5)
    return catalog, C.load_tracks(catalog, [r[0] for r in ids.select("catalog_track_id").collect()])


def _prepared(spark, d, in_order: bool = False):
    catalog, seeds = _request(spark, d, in_order)
    prepared = C.prepare(catalog, seeds, TOP, 20)
    _KEPT.append(prepared.candidates)
    return prepared, seeds


def _delivered(found) -> DataFrame:
    """The few rows of a recommendation, as they are sent; its pool is given back."""
    rows = found.rows.sparkSession.createDataFrame(found.rows.collect(), found.rows.schema)
    found.release()
    return rows


def _scores(spark, d, policy: Policy, adjustments=None) -> DataFrame:
    p, seeds = _prepared(spark, d)
    return _named(scored(p, seeds, policy, adjustments), "track_id", similarity="similarity", score="score")


def cosine_unweighted(spark, d):
    return _scores(spark, d, Policy("unweighted_cosine", use_pca=False))


def cosine_weighted(spark, d):
    return _scores(spark, d, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False))


def cosine_pca_full_rank(spark, d):
    """All ten axes: a rotation, so the cosine of centred vectors."""
    return _scores(spark, d, Policy("weighted_cosine", DEFAULT_WEIGHTS, pca_components=10))


def cosine_pca5(spark, d):
    return _scores(spark, d, Policy("weighted_cosine", DEFAULT_WEIGHTS, pca_components=5))


def pca_2d(spark, d):
    z = _scaled(spark, d)
    cols = [F.col("z_energy"), F.col("z_valence")]
    axes = fit_pca(z, cols, 2)
    u, v = axes.project(cols)
    # an axis has no direction of its own: the squares are compared
    return _named(z, "track_id", first=u * u, second=v * v)


def steered_rerank(spark, d):
    return _scores(spark, d, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False), STEER)


def explanations(spark, d):
    """Gaps are compared as they are, so that the last digit of a mean can decide between two traits."""
    p, seeds = _prepared(spark, d, in_order=True)
    return scored(p, seeds, Policy("unweighted_cosine", use_pca=False)).select("track_id", "recommendation_reason")


def _top(spark, d, policy, adjustments=None) -> DataFrame:
    rows = _delivered(recommend(*_request(spark, d), TOP, policy, adjustments))
    return rows.select("rank", "track_id", r6("similarity").alias("similarity"), r6("score").alias("score"))


def recommend_weighted(spark, d):
    return _top(spark, d, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False), STEER)


def recommend_deployed(spark, d):
    return _top(spark, d, Policy(weights=DEFAULT_WEIGHTS, randomize=True, seed=3))


def topn_popularity(spark, d):
    return _top(spark, d, Policy("popularity", use_pca=False))


def topn_random(spark, d):
    return _top(spark, d, Policy("random", use_pca=False, seed=5))


def topn_weighted_sample(spark, d):
    p, seeds = _prepared(spark, d)
    rows = recommend_prepared(p, seeds, TOP, Policy("weighted_cosine", DEFAULT_WEIGHTS, use_pca=False, randomize=True, seed=3)).rows
    return rows.select("rank", "track_id", r6("score").alias("score"))


# benchmark


def seed_split(spark, d):
    return R.seed_split(S.memberships(spark, d), 5, SPLITS, SEED).where("is_seed").select("playlist_id", "split_id", "place", "catalog_track_id")


def split_requests(spark, d):
    asked, _ = R.requests(S.memberships(spark, d), 5, SPLITS, SEED)
    return asked.select("playlist_id", "split_id", F.size("seeds").alias("num_seeds"), F.size("positives").alias("num_matched_positives"), F.col("num_positives").cast("long").alias("num_positives"))


def skipped_requests(spark, d):
    return R.requests(S.memberships(spark, d), 5, SPLITS, SEED)[1]


def playlist_partition(spark, d):
    return R.partition_playlists(S.memberships(spark, d), 0.2, SEED)


def _benchmark(spark, d) -> DataFrame:
    """All seven strategies on every playlist and split, with every track that is popular enough as a candidate."""
    cfg = BenchmarkConfig(num_splits=SPLITS, bootstrap_samples=100, seed=SEED, pca_components=AXES, candidate_limit=None)
    asked, _ = R.requests(S.memberships(spark, d), cfg.seed_size, cfg.num_splits, cfg.seed)
    return B.score_requests(asked, _kept(S.catalog(spark, d)), DEFAULT_STRATEGIES, cfg)


def benchmark_recommendations(spark, d):
    return _benchmark(spark, d).select("playlist_id", "split_id", "strategy", "rank", "track_id", r6("score").alias("score"))


def benchmark_per_split(spark, d):
    per, _ = B.split_metrics(_benchmark(spark, d), DEFAULT_STRATEGIES, BenchmarkConfig(num_splits=SPLITS))
    cols = ("precision_at_k", "recall_at_k", "ndcg_at_k", "matched_recall_at_k", "retrievable_recall_at_k", "matched_recall_ceiling", "candidate_recall_ceiling", "fill_rate", "artist_diversity", "avg_recommendation_popularity", "steering_target_distance")
    return _named(per, "playlist_id", "split_id", "strategy", "candidate_pool_size", **{c: c for c in cols})


def benchmark_summary(spark, d):
    """All seven strategies of the benchmark, with intervals and exposure; no candidate is left out."""
    cfg = BenchmarkConfig(num_splits=1, bootstrap_samples=50, seed=SEED, candidate_limit=None)
    return B.evaluate(S.catalog(spark, d), S.memberships(spark, d), cfg).summary


def _exposed(spark, d) -> DataFrame:
    """A log of what was shown: events as recommendations of a strategy."""
    e = S.table(spark, d, "events")
    return e.select(F.col("event_type").alias("strategy"), F.col("user_id").cast("string").alias("playlist_id"), (F.col("event_id") % 977).cast("string").alias("track_id"), F.col("value"))


def exposure_summary(spark, d):
    named = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("click", "view", "never")])).alias("strategy"))
    out = K.exposure(_exposed(spark, d), named, 2000)
    return out.select("strategy", "unique_recommendations", "total_recommendations", r6("recommendation_repeat_rate").alias("recommendation_repeat_rate"), r6("catalog_coverage").alias("catalog_coverage"))


def _log_metrics(spark, d) -> DataFrame:
    return K.playlist_means(_exposed(spark, d).select("playlist_id", "strategy", F.col("value").alias("ndcg_at_k"), (F.col("value") / 7).alias("recall_at_k")), ("ndcg_at_k", "recall_at_k"))


def playlist_means(spark, d):
    return _named(_log_metrics(spark, d), "playlist_id", "strategy", ndcg_at_k="ndcg_at_k", recall_at_k="recall_at_k")


def bootstrap_ci(spark, d):
    return _named(K.bootstrap(_log_metrics(spark, d), ("ndcg_at_k", "recall_at_k"), 50, 0.9, SEED), "strategy", "metric", mean="mean", ci_low="ci_low", ci_high="ci_high")


def trial_selection(spark, d):
    trials = _log_metrics(spark, d).groupBy("strategy").agg(F.round(F.avg("ndcg_at_k"), 1).alias("ndcg"), F.round(F.avg("recall_at_k"), 6).alias("recall"))
    trials = trials.select(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("strategy")).alias("index"), F.col("strategy").alias("name"), "ndcg", "recall")
    return R.best_trial(trials)


def target_distance(spark, d):
    items = S.memberships(spark, d).where("matched").select("playlist_id", F.col("catalog_track_id").alias("track_id"))
    recs = items.join(S.catalog(spark, d), "track_id")
    base = recs.groupBy("playlist_id").agg(F.median("energy").alias("b_energy"), F.median("valence").alias("b_valence"))
    return _named(K.target_distance(recs, base, ["playlist_id"], STEER), "playlist_id", steering_target_distance="steering_target_distance")


def diagnostics(spark, d):
    items = S.memberships(spark, d).where("matched").select("playlist_id", F.col("catalog_track_id").alias("track_id"))
    recs = items.join(S.catalog(spark, d), "track_id")
    return K.diagnostics(recs, ["playlist_id"], TOP, F.col("energy")).select("playlist_id", *[r6(c).alias(c) for c in ("fill_rate", "artist_diversity", "artist_duplication_rate", "avg_similarity", "avg_recommendation_popularity")])


LABELS_BLOCK = 10_000  # labels whose mean vectors are broadcast at a time


def embedding_cosine(spark, d, block: int = LABELS_BLOCK):
    """Vectors against the mean vector of each label: the label that fits best. Labels go in blocks, one after the other, and each row keeps its best so far."""
    e = S.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    blocks = -(-e.select("label").distinct().count() // block) or 1
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))
    fit = lambda m: F.round(F.coalesce(F.try_divide(dot(F.col("v"), m["m"]), size(F.col("v")) * size(m["m"])), F.lit(0.0)), 6)
    # the best by cosine, then by label: structs compare by their fields in order
    best = F.array_max(F.transform("means", lambda m: F.struct(fit(m).alias("cosine"), (-m["label"]).alias("l"))))
    out = e.select("vec_id", "v", F.lit(None).cast("struct<cosine:double,l:bigint>").alias("b"))
    for k in range(blocks):
        part = means.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k) if blocks > 1 else means
        part = part.groupBy().agg(F.collect_list(F.struct("label", "m")).alias("means"))
        out = out.crossJoin(F.broadcast(part)).select("vec_id", "v", F.greatest("b", best.cast("struct<cosine:double,l:bigint>")).alias("b"))
    return out.select("vec_id", (-F.col("b.l")).alias("label"), (F.col("b.cosine") + 0.0).alias("cosine"))


def hourly_events(spark, d):
    out = E.hourly(S.table(spark, d, "events"))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", r6("value").alias("value"))


def first_shown(spark, d):
    rows = E.shown(S.table(spark, d, "events"))
    return rows.groupBy("user_id", "track_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_shown"))


NAMES = (
    catalog_scan, typed_projection, filter_candidates, count_candidates, bounded_sample, load_tracks_ordered, point_lookup, fallback_candidates, exclude_same_artist, seen_exclusion,
    canon_title, canon_title_edges, canon_artist, parse_artists, parse_bool, playlist_id_extract, artist_display, track_uris, setting_scale, source_identity,
    normalize_rows, known_comma_artists, dedupe_by_id, dedupe_by_isrc, dedupe_by_canon_duration, merge_three_pass, duplicate_reduction,
    match_by_id, match_by_metadata, match_best, membership_labels, match_summary, label_builder, match_rollup, playlist_profile_rows, normalize_memberships, membership_audit, pairwise_jaccard,
    special_transforms, scaler_stats, impute_medians, scaled_features, weighted_features, profile_median, profile_mean,
    cosine_unweighted, cosine_weighted, cosine_pca_full_rank, cosine_pca5, pca_2d, steered_rerank, explanations, recommend_weighted, recommend_deployed, topn_popularity, topn_random, topn_weighted_sample,
    seed_split, split_requests, skipped_requests, playlist_partition, benchmark_recommendations, benchmark_per_split, benchmark_summary, exposure_summary, playlist_means, bootstrap_ci, trial_selection,
    target_distance, diagnostics, embedding_cosine, hourly_events, first_shown,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
