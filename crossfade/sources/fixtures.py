"""The engine's inputs derived from the order tables, for queries and tests.

A part is a track, a customer a playlist. Gaps are put in on purpose, so that
imputation and defaults have work: by part key, in popularity, tempo and
loudness. Tracks of size 50 are on playlists but not in the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOT_CARRIED = 50  # the p_size of tracks that the catalog doesn't carry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one key together, in the order in which their file has them.

    The last digit of a mean of doubles depends on the order in which they are
    added; grouped by ``key`` next, these are added one after the other as they
    stand, however many tasks have read the file.
    """
    place = ["_metadata.file_path", "_metadata.row_index"]
    rows = rows.select("*", *[F.col(c).alias(f"_{i}") for i, c in enumerate(place)])
    return rows.repartition(key).sortWithinPartitions(key, "_0", "_1").drop("_0", "_1")


def tracks(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Every part as a track with features from its order lines; ``in_order``: means are the same to the last digit on every plan."""
    rows = table(spark, sf_dir, "lineitem")
    lines = (in_file_order(rows, "l_partkey") if in_order else rows).groupBy("l_partkey").agg(
        F.count("*").alias("n"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        F.avg("l_quantity").alias("qty"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("ret"),
        F.avg((F.col("l_linestatus") == "O").cast("double")).alias("opn"),
        F.stddev_pop("l_discount").alias("sdisc"),
        F.stddev_pop("l_tax").alias("stax"),
    )
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    one = lambda c: F.least(F.lit(1.0), c)
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        k.cast("string").alias("track_id"),
        F.col("p_name").alias("title_raw"),
        T.canon_title(F.col("p_name")).alias("title_canon"),
        F.array("p_brand").alias("artists_raw"),
        T.canon_artist(F.array("p_brand")).alias("artist_primary_canon"),
        F.col("p_type").alias("album"),
        F.when(k % 13 != 0, F.least(F.lit(100), F.greatest(F.lit(0), 5 * (F.col("n") - 20)))).cast("int").alias("popularity"),
        (1960 + (k * 7) % 60).cast("int").alias("release_year"),
        one(10 * F.col("disc")).alias("danceability"),
        one(12.5 * F.col("tax")).alias("energy"),
        (F.col("qty") / 50).alias("valence"),
        F.col("ret").alias("acousticness"),
        F.col("opn").alias("instrumentalness"),
        one(20 * F.col("sdisc")).alias("liveness"),
        one(20 * F.col("stax")).alias("speechiness"),
        F.when(k % 17 != 0, 60.0 + 3 * F.col("p_size")).alias("tempo"),
        F.when(k % 19 != 0, -60 + F.col("p_retailprice") / 20).alias("loudness"),
        (F.col("p_size") * 9000 + (k % 7) * 1000).cast("int").alias("duration_ms"),
        F.col("p_size"),
    )


def catalog(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    return tracks(spark, sf_dir, in_order).where(F.col("p_size") != NOT_CARRIED).drop("p_size")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(playlist_id, position, part): every order line of a customer in order, repeats included."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).withColumn("playlist_id", F.col("o_custkey").cast("string"))
    # by the id as it is handed on, so that what groups by playlist next finds its rows together
    w = Window.partitionBy("playlist_id").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")
    return rows.select("playlist_id", (F.row_number().over(w) - 1).alias("position"), F.col("l_partkey").alias("part"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: each playlist's distinct tracks by first position, matched if the catalog carries them."""
    first = occurrences(spark, sf_dir).groupBy("playlist_id", "part").agg(F.min("position").alias("position"))
    sizes = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = first.join(sizes, first.part == sizes.p_partkey)
    there = F.col("p_size") != NOT_CARRIED
    return rows.select(
        "playlist_id", F.col("position").cast("long").alias("position"), F.col("part").cast("string").alias("source_track_id"), F.when(there, F.col("part").cast("string")).alias("catalog_track_id"), there.alias("matched")
    )


def playlist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as another service would list them: a third without an id, a third with a foreign one, titles with variant marks, shifted durations."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_brand", "p_size")
    rows = occurrences(spark, sf_dir).join(parts, "part")
    k = F.col("part")
    mark = F.when(k % 4 == 0, " - Live").when(k % 4 == 1, " (Remastered 2011)").when(k % 4 == 2, " [Radio Edit]").otherwise("")
    return rows.select(
        "playlist_id",
        F.col("position").cast("long").alias("position"),
        F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("x"), k.cast("string"))).alias("source_track_id"),
        F.concat("p_name", mark).alias("title"),
        F.array(F.upper("p_brand"), F.lit("Guest")).alias("artists"),
        F.when(k % 5 != 0, F.col("p_size") * 9000 + (k % 7) * 1000 + 1500).cast("long").alias("duration_ms"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three differently shaped sources of the same parts, all columns as text, with their order."""
    part = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    base = part.select(
        F.concat(F.lit("service:track:"), text(k)).alias("uri"),
        F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("artist"),
        text(s * 9000 + (k % 7) * 1000).alias("duration_ms"),
        F.when(k % 2 == 0, "True").otherwise("no").alias("explicit"),
        text(k % 100).alias("popularity"),
        F.concat(text(1960 + k % 60), F.lit("-01-01")).alias("release_year"),
        F.when(k % 3 == 0, F.concat(F.lit("I"), text(F.floor(k / 6)))).alias("isrc"),
        text(s / 50).alias("energy"),
        text(F.when(k % 11 == 0, -1).otherwise(60 + s)).alias("tempo"),
        F.col("p_type").alias("album"),
        k.alias("ord"),
    )
    chart = part.select(
        text(k).alias("track_id"),
        F.concat("p_name", F.when(k % 2 == 0, " (Live)").otherwise("")).alias("name"),
        F.concat("p_brand", F.lit(", Guest")).alias("artist_names"),
        text(s * 9000 + (k % 7) * 1000 + (k % 5) * 900).alias("duration"),
        text((k * 3) % 101).alias("track_popularity"),
        text(1961 + k % 59).alias("year"),
        text(F.when(k % 4 == 0, 1.5).otherwise(s / 100)).alias("valence"),
        k.alias("ord"),
    )
    nameless = part.select(
        F.lit(None).cast("string").alias("id"),
        F.upper("p_name").alias("title"),
        F.concat(F.lit("['"), F.col("p_brand"), F.lit("', 'Other']")).alias("artists"),
        text(s * 9000 + 400).alias("duration_ms"),
        F.when(k % 3 == 0, F.concat(F.lit("I"), text(F.floor(k / 6)))).alias("isrc"),
        k.alias("ord"),
    )
    return [base, chart, nameless]
