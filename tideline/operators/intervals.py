"""Points inside intervals of the same key: events, images and captions of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.sources.tables import cut

#: Length of a bucket of time, and the most points of a key and bucket that one task joins.
BUCKET_US, MOST = 86_400_000_000, 1_000_000


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket_us: int = BUCKET_US, most: int = MOST) -> DataFrame:
    """Pairs of a point and an interval of the same ``key`` with ``start <= at < end``; other columns must differ by name.

    The join's key is ``key`` and a bucket of time, so that one key with many points spreads over its buckets; an interval
    stands in each bucket that it touches. A bucket with more than ``most`` points is dealt on by a hash of the points,
    with its intervals in each part; such buckets are at most one to ``most`` points, so their list is broadcast."""
    bucket = lambda c: F.floor(c / bucket_us)
    dealt = points.filter(F.col(at).isNotNull() & F.col(key).isNotNull()).withColumn("__bucket", bucket(F.col(at)))
    spans = intervals.filter(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    heavy = dealt.groupBy(key, "__bucket").agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    heavy = cut(heavy.select(key, "__bucket", F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    if heavy.isEmpty():
        return dealt.join(spans, [key, "__bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")
    parts = F.coalesce("__parts", F.lit(1))
    dealt = dealt.join(F.broadcast(heavy), [key, "__bucket"], "left").withColumn("__part", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("__parts")
    spans = spans.join(F.broadcast(heavy), [key, "__bucket"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(spans, [key, "__bucket", "__part"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket", "__part")


def episode_events(episodes: DataFrame, events: DataFrame, bucket_us: int = BUCKET_US, most: int = MOST) -> DataFrame:
    """Events (``subject_id us ...``) with the ``episode_index`` of each episode that they lie in."""
    return interval_join(events, episodes.select("subject_id", "episode_index", "start_us", "end_us"), "subject_id", "us", "start_us", "end_us", bucket_us, most)


def said(text: Column) -> Column:
    """Text that is not blank."""
    return F.when(F.trim(F.regexp_replace(text, r"\s", " ")) != "", text)


def episode_images(episodes: DataFrame, posts: DataFrame, known: DataFrame) -> DataFrame:
    """``subject_id episode_index image n first_us caption`` for each image of each episode.

    ``posts`` are ``subject_id us seq image caption``, ``known`` gives captions by ``subject_id image``. A known caption
    that isn't empty comes first, then that of the first post of the image in the episode that isn't blank."""
    inside = episode_events(episodes, posts.filter("image IS NOT NULL"))
    text = said(F.col("caption"))
    per = inside.groupBy("subject_id", "episode_index", "image").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.min_by(text, F.when(text.isNotNull(), F.struct("us", "seq"))).alias("own"),
    )
    looked = known.groupBy("subject_id", "image").agg(F.min(F.nullif("caption", F.lit(""))).alias("looked"))
    return per.join(looked, ["subject_id", "image"], "left").select("subject_id", "episode_index", "image", "n", "first_us", F.coalesce("looked", "own").alias("caption"))
