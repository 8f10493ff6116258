"""The concepts of the timeline and place analytics on star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.scalars import micros

#: Sentiment of an event type.
SENTIMENT = {"purchase": "positive", "signup": "positive", "view": "neutral", "click": "neutral", "error": "negative"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentiment(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, label in SENTIMENT.items():
        out = F.when(event_type == kind, label).otherwise(out)
    return out


def emotion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id us seq label score event_type value``; ``us`` are microseconds since 1970."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("subject_id"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("seq"),
        sentiment(F.col("event_type")).alias("label"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"), "event_type", "value",
    )


EVENTS_SQL = """ev AS (SELECT user_id AS subject_id, epoch_us(ts) AS us, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'positive' WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'neutral' WHEN 'error' THEN 'negative' END AS label,
  least(value / 500.0, 1.0) AS score, event_type, value FROM events)"""

#: Multipliers that spread an event id over the five recovery dimensions.
CHIME = {"Connectedness": 3, "Hope": 7, "Identity": 11, "Meaning": 13, "Empowerment": 17}


def place_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject_id place_type us seq`` and a score per recovery dimension."""
    e = emotion_events(spark, sf_dir)
    return e.select("subject_id", F.col("event_type").alias("place_type"), "us", "seq", *((F.pmod(F.col("seq") * m, F.lit(101)) / 100.0).alias(d) for d, m in CHIME.items()))


VISITS_SQL = "visits AS (SELECT user_id AS subject_id, event_type AS place_type, epoch_us(ts) AS us, event_id AS seq, " + ", ".join(f'(event_id * {m}) % 101 / 100.0::DOUBLE AS "{d}"' for d, m in CHIME.items()) + " FROM events)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``place_id type language cultural_tags lat lon`` from customers, their nations and regions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    return joined.select(
        F.col("c_custkey").alias("place_id"), F.col("c_mktsegment").alias("type"), F.col("r_name").alias("language"),
        F.array("n_name", F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("cultural_tags"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(17000)) / 100.0 - 85).alias("lat"), (F.pmod(F.col("c_custkey") * 91, F.lit(35900)) / 100.0 - 179.5).alias("lon"),
    )


PLACES_SQL = """places AS (SELECT c_custkey AS place_id, c_mktsegment AS type, r_name AS language, [lower(trim(n_name)), lower(trim(c_mktsegment))] AS tags,
  (c_custkey * 37) % 17000 / 100.0::DOUBLE - 85 AS lat, (c_custkey * 91) % 35900 / 100.0::DOUBLE - 179.5 AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def location_sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``location_id us seq sentiment score``: an order is an entry about its customer's place."""
    o = table(spark, sf_dir, "orders")
    grade = F.substring("o_orderpriority", 1, 1)
    label = F.when(grade.isin("1", "2"), "positive").when(grade == "3", "neutral").otherwise("negative")
    return o.select(F.col("o_custkey").alias("location_id"), micros(F.col("o_orderdate")).alias("us"), F.col("o_orderkey").alias("seq"), label.alias("sentiment"), (F.pmod(F.floor("o_totalprice"), F.lit(1000)) / 1000.0).alias("score"))


LOCATIONS_SQL = """ls AS (SELECT o_custkey AS location_id, epoch_us(o_orderdate) AS us, o_orderkey AS seq,
  CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'positive' WHEN o_orderpriority[1:1] = '3' THEN 'neutral' ELSE 'negative' END AS sentiment,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0::DOUBLE AS score FROM orders)"""
