"""Timelines: per-subject order, bounds, gaps, fingerprints and exports. Times are microseconds ``us``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.scalars import digest, iso, seconds_text


def ordered(*extra: str) -> Window:
    return Window.partitionBy("subject_id").orderBy("us", "seq", *extra)


def build_timeline(events: DataFrame) -> DataFrame:
    """Events with ``event_index`` from 0 in time order; ties keep their input order ``seq``."""
    return events.withColumn("event_index", (F.row_number().over(ordered()) - 1).cast("long"))


def order_violations(events: DataFrame) -> DataFrame:
    """Events that come before the previous one of their subject in input order."""
    before = F.lag("us").over(Window.partitionBy("subject_id").orderBy("seq"))
    return events.withColumn("previous_us", before).filter(F.col("previous_us") > F.col("us"))


def bounds(events: DataFrame) -> DataFrame:
    """Count, first and last time, duration (0 below two events) and time span (null below two), seconds."""
    got = events.groupBy("subject_id").agg(F.count("*").alias("event_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    span = (F.col("end_us") - F.col("start_us")) / 1e6
    return got.withColumns({"duration": F.when(F.col("event_count") < 2, 0.0).otherwise(span), "time_span": F.when(F.col("event_count") >= 2, span)})


def gaps(events: DataFrame) -> DataFrame:
    """One row per pair of neighbouring events: ``gap_us``."""
    got = events.withColumn("gap_us", F.col("us") - F.lag("us").over(ordered()))
    return got.filter(F.col("gap_us").isNotNull())


def structural_fingerprint(events: DataFrame) -> DataFrame:
    """Digest of event count, duration and gaps; labels and scores don't enter."""
    rows = events.withColumn("gap_us", F.col("us") - F.lag("us").over(ordered()))
    got = rows.groupBy("subject_id").agg(
        F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span"),
        F.sort_array(F.collect_list(F.when(F.col("gap_us").isNotNull(), F.struct("us", "seq", "gap_us")))).alias("g"),
    )
    text = F.array_join(F.transform("g", lambda x: seconds_text(x["gap_us"])), "")
    return got.select("subject_id", digest(F.concat_ws(":", F.col("n").cast("string"), seconds_text(F.col("span")), digest(text, 16))).alias("fingerprint"))


#: What a post without a sentiment counts as: its score where posts are drawn, and where they are summed up.
MISSING_SCORE = {"shown": 0.0, "stored": None}


def of_posts(posts: DataFrame, missing: str = "shown") -> DataFrame:
    """Events (``subject_id us seq label score``) of posts (``user_id post_id timestamp label score``, the time as ISO
    text in UTC unless it says otherwise). A post without a label is neutral and without a score has that of ``missing``;
    one without a time is left out."""
    us = F.unix_micros(F.try_to_timestamp("timestamp"))
    score = F.coalesce(F.col("score"), F.lit(MISSING_SCORE[missing]).cast("double"))
    return posts.select(F.col("user_id").alias("subject_id"), us.alias("us"), F.col("post_id").alias("seq"), F.coalesce("label", F.lit("neutral")).alias("label"), score.alias("score")).filter("us IS NOT NULL")


def csv_rows(events: DataFrame) -> DataFrame:
    return events.select("subject_id", iso(F.col("us")).alias("timestamp"), F.col("label").alias("emotion_label"), "score", F.col("seq").cast("string").alias("source_id"))


def summary(events: DataFrame) -> DataFrame:
    """Per subject: count, span in seconds (0 for one event), first and last time, indexed events."""
    got = events.groupBy("subject_id").agg(F.count("*").alias("event_count"), F.min("us").alias("a"), F.max("us").alias("b"), F.sort_array(F.collect_list(F.struct("us", "seq", "label"))).alias("e"))
    listed = F.array_join(F.transform("e", lambda x, i: F.concat_ws(":", i.cast("string"), iso(x["us"]), x["label"])), ",")
    return got.select("subject_id", "event_count", ((F.col("b") - F.col("a")) / 1e6).alias("span_seconds"), iso(F.col("a")).alias("first"), iso(F.col("b")).alias("last"), listed.alias("events"))
