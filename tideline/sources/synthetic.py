"""Synthetic posts, each drawn from its user and number alone: no state, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: 2024-01-01 09:00.
BASE_US = 1_704_099_600_000_000
#: Posts of a user, days that they lie in, and the weights of positive, neutral and negative by a mark in
#: the user's name (the last ones hold without a mark).
LEAST, MOST, DAYS = 20, 40, 30
WEIGHTS = (("001", (60, 30, 10)), ("002", (20, 50, 30)), ("", (30, 30, 40)))
#: Labels of the categories of pictures; others are neutral. The score of a picture's post.
CATEGORIES = {"happy": "positive", "sad": "negative"}
PICTURE_SCORE = 0.9


def drawn(what: str, *by: Column) -> Column:
    """A number below 2^32 that depends on ``what`` and ``by`` alone."""
    text = F.concat_ws(":", F.lit(what), *(c.cast("string") for c in by))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def weighted(number: Column, labels: tuple[str, ...], weights: tuple[int, ...]) -> Column:
    """The label whose stretch of the summed weights holds ``number`` modulo the sum."""
    at, out, below = number % sum(weights), F.lit(labels[-1]), sum(weights)
    for label, weight in reversed(tuple(zip(labels, weights, strict=True))):
        below -= weight
        out = F.when(at < below + weight, label).otherwise(out)
    return out


def posts(users: DataFrame) -> DataFrame:
    """``user_id post_id us caption label score`` of 20 to 40 posts for each distinct ``user_id`` (text)."""
    users = users.select("user_id").filter("user_id IS NOT NULL").distinct()
    count = LEAST + drawn("posts", F.col("user_id")) % (MOST - LEAST + 1)
    rows = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    at = lambda what, n: drawn(what, F.col("user_id"), F.col("i")) % n
    us = BASE_US + at("day", DAYS) * DAY_US + at("hour", 24) * HOUR_US + at("minute", 60) * 60_000_000
    label, number = None, drawn("label", F.col("user_id"), F.col("i"))
    for mark, weights in reversed(WEIGHTS):
        choice = weighted(number, ("positive", "neutral", "negative"), weights)
        label = choice if label is None else F.when(F.contains("user_id", F.lit(mark)), choice).otherwise(label)
    name = F.concat(F.lit("post_"), "user_id", F.lit("_"), F.col("i").cast("string"))
    caption = F.concat(F.lit("Sample caption "), F.col("i").cast("string"), F.lit(" for "), "user_id")
    return rows.select("user_id", name.alias("post_id"), us.alias("us"), caption.alias("caption"), label.alias("label"), (0.5 + at("score", 500_000) / 1_000_000).alias("score"))


def with_pictures(posts: DataFrame, pictures: DataFrame) -> DataFrame:
    """Posts with ``image``. ``pictures`` are ``user_id position image caption category``, numbered from 0: those without
    a category go to the user's posts in order of time, the others become posts of their own, a day apart before the
    first one."""
    order = Window.partitionBy("user_id").orderBy("us", "post_id")
    numbered = posts.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    given = pictures.filter("category IS NULL").select("user_id", F.col("position").cast("int").alias("position"), "image")
    shown = numbered.join(given, ["user_id", "position"], "left").drop("position")
    own = pictures.filter("category IS NOT NULL")
    first = posts.groupBy("user_id").agg(F.min("us").alias("first_us"))
    total = own.groupBy("user_id").agg(F.count("*").alias("total"))
    own = own.join(total, "user_id").join(first, "user_id", "left")
    label = F.lit("neutral")
    for category, kind in CATEGORIES.items():
        label = F.when(F.col("category") == category, kind).otherwise(label)
    made = own.select(
        "user_id", F.concat(F.lit("post_"), "user_id", F.lit("_img_"), F.col("position").cast("string")).alias("post_id"),
        (F.coalesce("first_us", F.lit(BASE_US)) - (F.col("total") - F.col("position")) * DAY_US).alias("us"), F.coalesce("caption", F.lit("")).alias("caption"), label.alias("label"), F.lit(PICTURE_SCORE).alias("score"), "image",
    )
    return shown.unionByName(made)
