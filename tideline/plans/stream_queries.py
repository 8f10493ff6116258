"""Queries over streams: ingest into a table that is appended to, and rate limits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators.corrections import HOUR_US
from tideline.plans.trend_queries import ORACLES as TRENDS
from tideline.sources import appends, tables
from tideline.sources.adapters import emotion_events, table
from tideline.streaming import limits, online

POSTS = "user_id long, post_id long, ts timestamp, image_path string, caption string"
STORED = "user_id long, post_id long, ts timestamp, caption string, label string"


def sent_posts(spark, sf_dir):
    """Events as posts in two deliveries, the second of which sends every other post again. Some lack a caption or have a
    kind of file that isn't taken."""
    folder = f"{tables.scratch(spark)}/ingest-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    image = F.concat(F.lit("p"), n.cast("string"), F.when(n % 6 == 0, ".tiff").otherwise(".JPG"))
    caption = F.when(n % 5 == 0, "").when(n % 2 == 0, F.lit("a happy and bright walk")).otherwise("so sad")
    posts = e.select("user_id", n.alias("post_id"), F.col("ts").cast("timestamp").alias("ts"), image.alias("image_path"), caption.alias("caption"))
    posts.write.parquet(f"{folder}/in/part=0")
    posts.filter("post_id % 2 = 0").write.parquet(f"{folder}/in/part=1")
    return spark.readStream.schema(f"{POSTS}, part int").parquet(f"{folder}/in").drop("part"), folder


def enriched(posts):
    fine = appends.checked_posts(posts).filter("problem IS NULL")
    label = T.sentiment_record(T.lexicon_sentiment(F.col("caption")))["label"]
    return fine.select("user_id", "post_id", "ts", "caption", label.alias("label"))


def ingested(spark, sf_dir):
    stream, folder = sent_posts(spark, sf_dir)
    online.ingest(stream, "post_id", f"{folder}/table", folder, "1000 days", enriched)
    return appends.read(spark, f"{folder}/table", STORED)


def ingested_ids(spark, sf_dir):
    return ingested(spark, sf_dir).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"))


def rejected(spark, sf_dir):
    stream, folder = sent_posts(spark, sf_dir)
    return appends.checked_posts(spark.read.schema(POSTS).parquet(f"{folder}/in/part=0")).groupBy("problem").agg(F.count("*").alias("n"))


def appended(spark, sf_dir):
    """Keywords of two appends, the first of which is handed over twice: pushes by event, in the order of their ids."""
    path = f"{tables.scratch(spark)}/keywords-{uuid.uuid4().hex}"
    e = emotion_events(spark, sf_dir).filter("label <> 'neutral'").select(F.col("subject_id").alias("user_id"), F.col("label").alias("kind"), F.concat(F.lit("k"), (F.col("seq") % 9).cast("string")).alias("keyword"), "seq")
    first, second = (e.filter(f"seq % 2 = {i}").repartitionByRange(8, "seq").sortWithinPartitions("seq").drop("seq") for i in (0, 1))
    for rows, batch in ((first, "a"), (first, "a"), (second, "b")):
        appends.append(spark, path, rows, batch)
    got = appends.keyword_lists(appends.read(spark, path, "user_id long, kind string, keyword string"))
    return got.select("user_id", *(F.array_join(f"{k}_keywords", ",").alias(f"{k}_keywords") for k in appends.KINDS))


def stream_limits(spark, sf_dir):
    """Attempts in files by a rest of their number, so that they arrive in no order of time, and a far later one."""
    folder = f"{tables.scratch(spark)}/limits-{uuid.uuid4().hex}"
    e = emotion_events(spark, sf_dir).select("subject_id", "seq", "us", F.timestamp_micros("us").alias("ts"))
    last = spark.createDataFrame([(-1, -1, 1_893_456_000_000_000)], "subject_id long, seq long, us long").withColumn("ts", F.timestamp_micros("us"))
    e.unionByName(last).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("subject_id long, seq long, us long, ts timestamp").parquet(f"{folder}/in")
    got = online.run_to_end(limits.rate_limited(stream, "1 hour", 2, 12 * HOUR_US), folder)
    return got.filter("subject_id >= 0").select("subject_id", "seq", "in_last_hour", "allowed")


QUERIES = {
    "stream_ingest": lambda s, d: ingested(s, d).drop("id", "version"),
    "stream_ingest_ids": ingested_ids,
    "rejected_posts": rejected,
    "keyword_upserts": appended,
    "stream_rate_limit": stream_limits,
}
FINE = "event_id % 5 <> 0 AND event_id % 6 <> 0"
ORACLES = {
    "stream_ingest": f"SELECT user_id, event_id AS post_id, ts::TIMESTAMP AS ts, CASE WHEN event_id % 2 = 0 THEN 'a happy and bright walk' ELSE 'so sad' END AS caption, CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS label FROM events WHERE {FINE}",
    "stream_ingest_ids": f"SELECT count(*) AS n, 1::BIGINT AS first_id, count(*) AS last_id, count(*) AS ids FROM events WHERE {FINE}",
    "rejected_posts": "SELECT CASE WHEN event_id % 5 = 0 THEN 'Missing required fields: caption' WHEN event_id % 6 = 0 THEN 'Unsupported file extension' END AS problem, count(*) AS n FROM events GROUP BY ALL",
    "keyword_upserts": """WITH k AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' ELSE 'negative' END AS kind, 'k' || event_id % 9 AS keyword FROM events WHERE event_type IN ('purchase', 'signup', 'error'))
SELECT user_id, coalesce(string_agg(keyword, ',' ORDER BY event_id % 2, event_id) FILTER (WHERE kind = 'positive'), '') AS positive_keywords, coalesce(string_agg(keyword, ',' ORDER BY event_id % 2, event_id) FILTER (WHERE kind = 'negative'), '') AS negative_keywords FROM k GROUP BY user_id""",
    "stream_rate_limit": TRENDS["correction_rate_limit"],
}
