"""Streaming variants: session episodes, window scores, deduplicated ingest and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.scalars import micros, ordinal
from tideline.sources import appends


def session_episodes(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Episodes of a stream of ``subject_id ts label``: a session closes when the watermark is past it.

    Sessions join events at most ``gap`` apart, as batch episodes do; the end is that of the last event."""
    late = events.withWatermark("ts", watermark)
    got = late.groupBy("subject_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("event_count"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return got.select("subject_id", micros(F.col("first")).alias("start_us"), micros(F.col("last")).alias("last_us"), "event_count")


def window_scores(events: DataFrame, width: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Mean label ordinal per subject and tumbling (or sliding) window on the epoch's grid."""
    late = events.withWatermark("ts", watermark)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = late.groupBy("subject_id", w.alias("w")).agg(F.avg(ordinal(F.col("label"))).alias("window_score"), F.count("*").alias("event_count"))
    return got.select("subject_id", micros(F.col("w.start")).alias("start_us"), "window_score", "event_count")


def deduplicated(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """Each key once within the watermark, for at-least-once sources."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def ingest(posts: DataFrame, key: str, path: str, folder: str, watermark: str, enrich=None):
    """Posts (with ``ts``) of a source that may send them again, each appended once to the table at ``path``. Runs until
    all that is there is processed; the query tells how many came too late."""
    writer = deduplicated(posts, key, watermark).writeStream.foreachBatch(appends.sink(path, key, enrich))
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query) -> int:
    """Rows that a query dropped as they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is there and read what was emitted; state and output are in ``folder``."""
    spark = stream.sparkSession
    out, state = f"{folder}/out", f"{folder}/state"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
