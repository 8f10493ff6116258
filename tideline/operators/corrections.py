"""Corrections: rate limit, latest label and the training queue. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.operators.ordered import ordered_fold

HOUR_US = 3_600_000_000


def rate_limited(corrections: DataFrame, most: int = 10, within_us: int = HOUR_US) -> DataFrame:
    """Attempts with how many corrections of the user were stored in the hour up to each, and whether it was allowed.

    Only an allowed attempt is stored, so each answer hangs on the ones before: a fold that holds ``most`` times."""

    def step(stored, us):
        stored = [t for t in stored if t >= us - within_us]
        n = len(stored)
        return stored + [us] * (n < most), (n, n < most)

    return ordered_fold(corrections, "subject_id", ["us", "seq"], ["us"], list, step, "in_last_hour bigint, allowed boolean")


def pending(posts: DataFrame) -> DataFrame:
    """``waiting``: posts (``label status``) that have a corrected label and weren't used for training yet."""
    return posts.agg(F.count_if(F.col("label").isNotNull() & (F.col("status") == "pending")).alias("waiting"))


def latest_correction(corrections: DataFrame) -> DataFrame:
    """The history is append-only; the last label wins."""
    return corrections.groupBy("subject_id", "post_id").agg(F.max_by("label", F.struct("us", "seq")).alias("label"), F.count("*").alias("history"))


def claim(posts: DataFrame, now_us: int, batch: int = 50, stale_us: int = HOUR_US) -> DataFrame:
    """One transition of the queue ``posts`` (``seq us status claimed_us``), status pending / processing / done.

    Rows that have been in processing for longer than ``stale_us`` are pending again. When at least ``batch`` are
    pending, the ``batch`` oldest are claimed. A pure function of the snapshot: a single writer applies it."""
    stale = (F.col("status") == "processing") & (F.col("claimed_us") < now_us - stale_us)
    reset = posts.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))
    pending = reset.filter("status = 'pending'")
    ready = pending.agg((F.count("*") >= batch).alias("ready"))
    taken = pending.orderBy("us", "seq").limit(batch).select("seq", F.lit(True).alias("taken")).crossJoin(F.broadcast(ready)).filter("ready").select("seq", "taken")
    got = reset.join(taken, "seq", "left")
    return got.select("seq", "us", F.when(F.col("taken"), "processing").otherwise(F.col("status")).alias("status"), F.when(F.col("taken"), F.lit(now_us)).otherwise(F.col("claimed_us")).alias("claimed_us"))


def promotion_gate(anchors: DataFrame, fresh: DataFrame, least_anchors: float = 0.8, least_fresh: float = 0.5) -> DataFrame:
    """Whether a retrained model passes: shares of right predictions (``label predicted``) on both sets."""
    share = lambda df, name: df.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias(name))
    got = share(anchors, "anchor_accuracy").crossJoin(share(fresh, "fresh_accuracy"))
    return got.withColumn("promote", (F.col("anchor_accuracy") >= least_anchors) & (F.col("fresh_accuracy") >= least_fresh))
