"""Entity resolution: raw track tables to one canonical catalog.

Every table becomes rows of one schema, in a fixed order, with their canonical
forms. Three passes then merge rows by id, by ISRC and by canonical title,
artist and duration bucket. Each is one aggregation whose fields are folded in
the order of the rows; a row without a key is a group of its own. Canonical
forms go along with the text that they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.features import numeric
from ..schema import DEDUPE_BUCKET_MS, DURATION_TOLERANCE_MS
from ..sources.tables import map_header, text_column
from .durations import fold_in_order

# fixed values: the columns of the merged catalog
UNIT_FEATURES = ("danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness")
OTHER_FEATURES = ("loudness", "tempo", "key", "mode")
COLUMNS = (
    "track_id", "title_raw", "title_canon", "artists_raw", "artist_primary_canon", "duration_ms", "explicit", "popularity", "release_year", "isrc", "album",
    "danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness", "loudness", "tempo", "key", "mode",
)
KNOWN_BOUND = 20_000  # names with commas that go along as one broadcast map; more are looked up by a join
GATHERED = 10_000  # durations of one key that are gathered in one row, at most
_PASS = (1 << 58, 1 << 59, 1 << 60)  # added to the order of rows without a key, pass by pass


def whole(c: Column) -> Column:
    """A number cut to an integer; null for anything else."""
    d = c.try_cast("double")  # no NaN is less than the bound
    return F.when(F.abs(d) < 2_000_000_000, d.cast("long").cast("int"))


def normalize(df: DataFrame, known: Column | None = None, columns: Mapping[str, str | None] | None = None, order: Column | None = None) -> DataFrame:
    """One raw table in the canonical schema, with its order ``ord``; ``known`` is a map of names with commas."""
    m = columns or map_header(df.columns)
    col = lambda f: text_column(df, m.get(f))
    # a column of its own, worked out once for the list and for the first name's form
    df = df.withColumn("_artists", T.parse_artists(col("artists"), m.get("artists") or "", known))
    artists = F.col("_artists")
    title = F.coalesce(T.strip(col("name")), F.lit(""))
    tempo = numeric(col("tempo"))
    fields = {
        "track_id": T.track_id(col("id")),
        "title_raw": title,
        "title_canon": T.canon_title(title),
        "artists_raw": artists,
        "artist_primary_canon": T.canon_artist(artists),
        "duration_ms": whole(col("duration")),
        "explicit": T.parse_bool(col("explicit")),
        "popularity": whole(col("popularity")),
        "release_year": whole(F.substring(col("release_year"), 1, 4)),
        "isrc": T.clean_id(col("isrc")),
        "album": T.clean_id(col("album")),
        **{f: F.when(numeric(col(f)).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), numeric(col(f))))) for f in UNIT_FEATURES},
        "loudness": numeric(col("loudness")),
        "tempo": F.when(tempo > 0, tempo),
        "key": whole(col("key")),
        "mode": whole(col("mode")),
    }
    return df.select(*[fields[c].alias(c) for c in COLUMNS], (order if order is not None else F.monotonically_increasing_id()).alias("ord"))


def _order(df: DataFrame, table: int) -> Column:
    """The order of rows over all tables: by table, then by its own ``ord``, or as it happens to be read."""
    return F.lit(table << 50) + (F.col("ord").cast("long") if "ord" in df.columns else F.monotonically_increasing_id())


def known_names(frames: Sequence[DataFrame]) -> DataFrame:
    """(key, name) of artists whose own name has commas, from columns that hold one artist or a list; the first spelling stays."""
    parts = []
    for i, df in enumerate(frames):
        name = map_header(df.columns)["artists"]
        if name and name.lower() != "artist_names":
            # each text is parsed once, however many rows have it
            texts = df.select(text_column(df, name).alias("text"), _order(df, i).alias("ord")).groupBy("text").agg(F.min("ord").alias("ord"))
            found = texts.select(F.explode(T.parse_artists(F.col("text"), name)).alias("name"), "ord")
            parts.append(found.withColumn("parts", T.split_names(F.col("name"))).where("size(parts) > 1").select(T.name_key(F.col("parts")).alias("key"), "name", "ord"))
    if not parts:
        return frames[0].sparkSession.createDataFrame([], "key string, name string") if frames else None
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min_by("name", "ord").alias("name"))


def with_known(df: DataFrame, known: DataFrame) -> tuple[DataFrame, Column | None]:
    """``df`` with a map of the known names that its artist column can hold, and that map's column."""
    name = map_header(df.columns)["artists"]
    if not name or name.lower() != "artist_names":
        return df, None
    entries = F.map_from_entries(F.collect_list(F.struct("key", "name")))
    few = known.limit(KNOWN_BOUND + 1).collect()
    if not few:
        return df, None
    if len(few) <= KNOWN_BOUND:
        # as literal rows, so that no plan derives them again
        rows = df.sparkSession.createDataFrame([({r["key"]: r["name"] for r in few},)], "_known map<string,string>")
        return df.crossJoin(F.broadcast(rows)), F.col("_known")
    # each row looks up the runs of parts that it has
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    parts = T.split_names(T.clean_id(text_column(df, name)))
    runs = rows.select("_row", parts.alias("p")).where("size(p) > 1")
    runs = runs.select("_row", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i")).select("_row", "p", "i", F.explode(F.sequence(F.col("i") + 1, F.size("p"))).alias("j"))
    found = runs.select("_row", T.name_key(F.slice("p", F.col("i"), F.col("j") - F.col("i") + 1)).alias("key")).distinct().join(known, "key")
    maps = found.groupBy("_row").agg(entries.alias("_known"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.join(maps, "_row", "left").withColumn("_known", F.coalesce("_known", none)), F.col("_known")


def dealt(df: DataFrame, table: int = 0) -> DataFrame:
    """A raw table with its order over all tables, dealt out by it.

    A file of one block is one task's to read, however many rows it has; its
    texts needn't be. There are as many parts as a shuffle has: adaptive plans
    would bring together what is small, however long its texts take.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_order", _order(df, table)).repartition(parts, "_order")


def union_normalized(frames: Sequence[DataFrame], known: DataFrame | None = None) -> DataFrame:
    """All tables in the canonical schema, in the order of tables, then rows."""
    known = known if known is not None else known_names(frames)
    parts = []
    for i, df in enumerate(frames):
        columns = map_header(df.columns)
        rows = dealt(df, i)
        wide, names = with_known(rows, known) if known is not None else (rows, None)
        parts.append(normalize(wide, names, columns, F.col("_order")))
    return reduce(DataFrame.unionByName, parts)


def _first(c: str, order: str = "ord") -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def _longest(c: str, size: Column) -> Column:
    return F.max_by(c, F.when(size > 0, F.struct(size, -F.col("ord"))))


def fold_durations(pairs: Column) -> Column:
    """Of (ord, duration) structs without null: the first, raised by each later one that is within the tolerance."""
    values = F.transform(F.array_sort(pairs), lambda p: p["d"])
    near = lambda a, d: F.when(F.abs(a - d) <= DURATION_TOLERANCE_MS, F.greatest(a, d)).otherwise(a)
    return F.aggregate(values, F.lit(None).cast("int"), lambda a, d: F.when(a.isNull(), d).otherwise(near(a, d)))


def _with_form(text: str, form: str, size: Column) -> Column:
    """The longest text and its canonical form; only empty texts have a form without one."""
    return F.max_by(F.struct(text, form), F.when(size > 0, F.struct(size, -F.col("ord"))))


def _most(rows: DataFrame, key: Sequence[Column], present: Column) -> int:
    """The most rows that a key has; those without one don't count."""
    # a key is told by its hash: two that share one count as one, which is never less
    counts = rows.select(F.when(present, F.xxhash64(*key)).alias("h")).groupBy("h").agg(F.count("h").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def merge_by(rows: DataFrame, key: Sequence[Column], step: int, ranged: bool = False) -> DataFrame:
    """Rows of one key as one row; rows without a key follow, unchanged, behind all merged ones.

    All of it is one aggregation, which gathers the durations of a key in one
    row. With ``ranged`` the rows of each key are counted first, here and now.
    If a key has more than ``GATHERED``, none are gathered: keys whose durations
    lie apart are folded by ranges of rows (see ``durations``), for which
    ``rows`` are read again; they should then be a table.
    """
    present = F.coalesce(reduce(lambda a, b: a & b, [k.isNotNull() for k in key]), F.lit(False))
    names = [f"_k{i}" for i in range(len(key))]
    ranged = ranged and _most(rows, key, present) > GATHERED
    marked = rows.select("*", *[F.when(present, k).alias(n) for n, k in zip(names, key, strict=True)], F.when(~present, F.col("ord")).alias("_own"))
    firsts = ["track_id", "isrc", *UNIT_FEATURES, *OTHER_FEATURES]
    gathered = fold_durations(F.collect_list(F.when(F.col("duration_ms").isNotNull(), F.struct("ord", F.col("duration_ms").alias("d")))))
    out = marked.groupBy(*names, "_own").agg(
        *[_first(c).alias(c) for c in firsts],
        _with_form("title_raw", "title_canon", F.char_length("title_raw")).alias("_title"),
        _with_form("artists_raw", "artist_primary_canon", F.size("artists_raw")).alias("_artists"),
        F.min("title_canon").alias("_title_canon"),
        F.min("artist_primary_canon").alias("_artist_canon"),
        _longest("album", F.char_length("album")).alias("album"),
        F.max("popularity").alias("popularity"),
        F.bool_or("explicit").alias("explicit"),
        F.max("release_year").alias("release_year"),
        *([F.min("duration_ms").alias("_low"), F.max("duration_ms").alias("duration_ms")] if ranged else [gathered.alias("duration_ms")]),
        F.min("ord").alias("ord"),
    )
    out = out.withColumns(
        {
            "title_raw": F.coalesce("_title.title_raw", F.lit("")),
            "title_canon": F.coalesce("_title.title_canon", "_title_canon"),
            "artists_raw": F.coalesce("_artists.artists_raw", F.array().cast("array<string>")),
            "artist_primary_canon": F.coalesce("_artists.artist_primary_canon", "_artist_canon"),
            "ord": F.when(F.col("_own").isNotNull(), F.col("ord") + F.lit(_PASS[step])).otherwise(F.col("ord")),
        }
    )
    if not ranged:
        return out.select(*COLUMNS, "ord")
    # durations that are all within the tolerance end at the longest; only of other keys does their order matter
    apart = out.where(F.col("duration_ms") - F.col("_low") > DURATION_TOLERANCE_MS).select(*names)
    folded = fold_in_order(marked.select(*names, "ord", "duration_ms").join(apart, names, "left_semi"), names, "ord", "duration_ms", "_folded")
    out = out.join(folded, names, "left").withColumn("duration_ms", F.coalesce("_folded", "duration_ms"))
    return out.select(*COLUMNS, "ord")


def merge_by_id(rows: DataFrame, ranged: bool = False) -> DataFrame:
    return merge_by(rows, [F.col("track_id")], 0, ranged)


def merge_by_isrc(rows: DataFrame, ranged: bool = False) -> DataFrame:
    return merge_by(rows, [F.col("isrc")], 1, ranged)


def merge_by_canon(rows: DataFrame, bucket_ms: int = DEDUPE_BUCKET_MS, ranged: bool = False) -> DataFrame:
    """By canonical title, artist and duration bucket (rounded half to even); an empty name or no duration is no key."""
    if bucket_ms <= 0:
        raise ValueError("the bucket must be longer than zero")
    bucket = F.rint(F.col("duration_ms") / F.lit(bucket_ms)).cast("long")
    return merge_by(rows, [F.nullif("title_canon", F.lit("")), F.nullif("artist_primary_canon", F.lit("")), bucket], 2, ranged)


def drop_repeats(rows: DataFrame) -> DataFrame:
    """The first row of each id, ISRC, canonical title, artist and duration; nulls are alike."""
    w = Window.partitionBy("track_id", "isrc", "title_canon", "artist_primary_canon", "duration_ms").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_tables(frames: Sequence[DataFrame], bucket_ms: int = DEDUPE_BUCKET_MS, write: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All passes; the result still has ``ord``, the order of its rows.

    ``write`` writes a pass's rows under a name and reads them back. With it no
    key's rows are gathered, however many there are; without it the passes are one plan.
    """
    keep = write or (lambda rows, name: rows)
    ranged = write is not None
    rows = keep(union_normalized(frames), "normalized")
    rows = keep(merge_by_id(rows, ranged), "by-id")
    rows = keep(merge_by_isrc(rows, ranged), "by-isrc")
    return drop_repeats(merge_by_canon(rows, bucket_ms, ranged))


def reduction_rate(raw: Column, merged: Column) -> Column:
    """The share of rows that merging has removed, 0 without rows."""
    rate = F.coalesce(F.try_divide(merged.cast("double"), raw.cast("double")), F.lit(1.0))
    return F.greatest(F.lit(0.0), 1 - rate)


