"""What has been shown to whom, kept up by a stream, and left out of later requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(schema).parquet(path)


def shown(events: DataFrame, kinds: tuple[str, ...] = ("view",), late: str = "1 hour") -> DataFrame:
    """The first time that each user was shown each track, once per event id within the lateness allowed."""
    rows = events.where(F.col("event_type").isin(*kinds))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        rows = rows.dropDuplicates(["event_id"])
    return rows.select(F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("track_id"), "ts").where("track_id is not null")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each kind per hour of event time."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def keep_exposure(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what each micro-batch shows to a table, one folder per batch: a batch that is run again replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("user_id", "track_id").agg(F.min("ts").alias("first_shown")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return shown(events).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposure_table(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, track_id, first_shown) over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("user_id", "track_id").agg(F.min("first_shown").alias("first_shown"))


def unseen(candidates: DataFrame, exposure: DataFrame, user_id: str) -> DataFrame:
    """Candidates that a user hasn't been shown."""
    return candidates.join(exposure.where(F.col("user_id") == user_id).select("track_id"), "track_id", "left_anti")
