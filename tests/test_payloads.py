"""Points in intervals, payloads and synthetic posts on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals, serialize
from tideline.sources import synthetic


@pytest.mark.parametrize("most", [intervals.MOST, 3])
def test_points_in_intervals(spark, most):
    rng = random.Random(most)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(-300, 300), 50, None]), i % 90) for i in range(400)]
    spans = [(rng.choice([1, 1, 2, 3, None]), (a := rng.randrange(-300, 300)), a + rng.choice([0, 1, 7, 100, 500]), i) for i in range(60)]
    got = intervals.interval_join(spark.createDataFrame(points, "k long, at long, p long"), spark.createDataFrame(spans, "k long, a long, b long, s long"), "k", "at", "a", "b", bucket_us=40, most=most)
    want = [(k, at, p, a, b, s) for k, at, p in points for q, a, b, s in spans if k is not None and k == q and at is not None and a <= at < b]
    assert sorted(tuple(r[c] for c in ("k", "at", "p", "a", "b", "s")) for r in got.collect()) == sorted(want)
    assert len(want) > 200


def test_one_subject_spreads_over_tasks(spark):
    """A subject with all of the points: buckets of time, and a hash within the one that holds most of them."""
    points = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 3000, F.col("id") % 40).otherwise(F.col("id")).alias("at"), F.col("id").alias("p"))
    spans = spark.createDataFrame([(1, 0, 5000)], "k long, a long, b long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = intervals.interval_join(points, spans, "k", "at", "a", "b", bucket_us=100, most=100)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000


def test_captions_of_images(spark):
    posts = [(1, 10, 1, "a", " \n"), (1, 30, 3, "a", "second"), (1, 20, 2, "a", "first"), (1, 20, 4, None, "no image"), (1, 100, 5, "a", "other episode"), (1, 25, 6, "b", None), (2, 10, 7, "a", "x"), (1, 40, 8, "c", "own")]
    episodes = [(1, 0, 0, 50), (1, 1, 100, 101), (2, 0, 11, 20)]
    known = [(1, "c", "looked up"), (2, "a", "y"), (1, "a", "")]
    got = intervals.episode_images(spark.createDataFrame(episodes, "subject_id long, episode_index long, start_us long, end_us long"), spark.createDataFrame(posts, "subject_id long, us long, seq long, image string, caption string"), spark.createDataFrame(known, "subject_id long, image string, caption string"))
    assert {(r["subject_id"], r["episode_index"], r["image"], r["n"], r["first_us"], r["caption"]) for r in got.collect()} == {(1, 0, "a", 3, 10, "first"), (1, 0, "b", 1, 25, None), (1, 0, "c", 1, 40, "looked up"), (1, 1, "a", 1, 100, "other episode")}


def test_payloads_are_canonical(spark):
    events = spark.createDataFrame([(7, 3_000_000, 2, "neutral", None, None, None), (7, 1_500_000, 1, "positive", 0.1, "s", {"b": "2"})], "subject_id long, us long, seq long, label string, score double, source_id string, metadata map<string,string>")
    payload = serialize.timeline_payloads(events)
    row = payload.first()
    want = {"subject_id": "7", "events": [{"timestamp": "1970-01-01T00:00:01.500000", "emotion_label": "positive", "score": 0.1, "source_id": "s", "metadata": {"b": "2"}}, {"timestamp": "1970-01-01T00:00:03", "emotion_label": "neutral"}]}
    assert row["data_json"] == json.dumps(want, sort_keys=True, separators=(",", ":")) and row["schema_version"] == "1.0"
    text = serialize.envelopes(payload).first()["json"]
    assert text == json.dumps({"schema_version": "1.0", "fingerprint": row["fingerprint"], "data": want}, sort_keys=True, separators=(",", ":"))
    assert serialize.read_envelopes(serialize.envelopes(payload)).collect() == payload.select("fingerprint", "schema_version", "data_json").collect()
    back = serialize.read_timelines(payload).orderBy("place").collect()
    assert [(r["place"], r["score"], r["metadata"]) for r in back] == [(0, 0.1, {"b": "2"}), (1, None, None)]


def test_episodes_and_graphs_without_events_or_edges(spark):
    episodes = spark.createDataFrame([(7, 0, "e0", 0, 5_000_000)], "subject_id long, episode_index long, episode_id string, start_us long, end_us long")
    none = spark.createDataFrame([], "subject_id long, episode_index long, us long, seq long, label string, score double")
    assert json.loads(serialize.episode_payloads(episodes, none).first()["data_json"]) == {"end_time": "1970-01-01T00:00:05", "events": [], "source_subject_id": "7", "start_time": "1970-01-01T00:00:00"}
    edges = spark.createDataFrame([], "subject_id long, source_index long, target_index long, relation string")
    graph = serialize.graph_payloads(episodes, none, edges, spark.createDataFrame([(7, "g")], "subject_id long, graph_id string"), 43_200_000_000)
    assert json.loads(graph.first()["data_json"])["edges"] == [] and serialize.read_edges(graph).count() == 0
    assert [(r["node"], r["event_count"]) for r in serialize.read_nodes(graph).collect()] == [(0, 0)]


def test_posts_do_not_depend_on_partitions(spark):
    users = spark.createDataFrame([(f"user_00{i}",) for i in range(9)] + [(None,), ("user_001",)], "user_id string")
    one, many = synthetic.posts(users.coalesce(1)), synthetic.posts(users.repartition(7))
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, many.collect()))
    counts = {r["user_id"]: r["count"] for r in one.groupBy("user_id").count().collect()}
    assert len(counts) == 9 and all(20 <= n <= 40 for n in counts.values())


def test_labels_follow_their_weights(spark):
    users = spark.range(400).select(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("-001")).alias("user_id"))
    posts = synthetic.posts(users)
    shares = {r["label"]: r["count"] / posts.count() for r in posts.groupBy("label").count().collect()}
    assert shares == pytest.approx({"positive": 0.6, "neutral": 0.3, "negative": 0.1}, abs=0.02)
    bounds = posts.agg(F.min("us"), F.max("us"), F.min("score"), F.max("score")).first()
    assert synthetic.BASE_US <= bounds[0] and bounds[1] < synthetic.BASE_US + 30 * synthetic.DAY_US and 0.5 <= bounds[2] and bounds[3] < 1


def test_pictures_on_posts_and_before_them(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    pictures = spark.createDataFrame([("a", 0, "x", None, None), ("a", 1, "y", None, None), ("b", 0, "p", "cap", "happy"), ("b", 1, "q", None, "odd")], "user_id string, position int, image string, caption string, category string")
    rows = synthetic.with_pictures(synthetic.posts(users), pictures).orderBy("user_id", "us", "post_id").collect()
    a, b = ([r for r in rows if r["user_id"] == u] for u in "ab")
    assert [r["image"] for r in a][:3] == ["x", "y", None]
    assert [(r["image"], r["label"], r["caption"], r["score"]) for r in b[:2]] == [("p", "positive", "cap", 0.9), ("q", "neutral", "", 0.9)]
    assert [b[2]["us"] - r["us"] for r in b[:2]] == [2 * synthetic.DAY_US, synthetic.DAY_US]
