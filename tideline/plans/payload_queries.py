"""Queries over events inside episodes, serialised payloads that are read back, and synthetic posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import iso_sql
from tideline.operators import graphs, intervals, segments, serialize
from tideline.plans.graph_queries import NEAR, ORACLES as GRAPHS, graph
from tideline.plans.timelines import EPISODES_SQL, GAP, episodes
from tideline.sources import synthetic
from tideline.sources.adapters import EVENTS_SQL, emotion_events, table


def posts(spark, sf_dir):
    """Events as posts: every third has an image, some captions are missing or blank."""
    e = emotion_events(spark, sf_dir)
    caption = F.when(F.col("seq") % 4 == 0, None).when(F.col("seq") % 4 == 1, F.lit(" \t")).otherwise(F.concat(F.lit("caption "), F.col("seq").cast("string")))
    image = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("img"), (F.col("seq") % 5).cast("string")))
    return e.select("subject_id", "us", "seq", image.alias("image"), caption.alias("caption"))


def known_captions(spark, sf_dir):
    """Of customers with a key below 5 by the rest of 10, for two images, one of them empty."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 < 5")
    return c.select(F.col("c_custkey").alias("subject_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("subject_id", F.concat(F.lit("img"), F.col("k").cast("string")).alias("image"), F.when(F.col("k") == 1, "known").otherwise("").alias("caption"))


def images(spark, sf_dir):
    return intervals.episode_images(episodes(spark, sf_dir), posts(spark, sf_dir), known_captions(spark, sf_dir))


def inside(spark, sf_dir):
    return intervals.episode_events(episodes(spark, sf_dir), emotion_events(spark, sf_dir)).select("subject_id", "episode_index", "seq")


def timelines_read(spark, sf_dir):
    texts = serialize.envelopes(serialize.timeline_payloads(emotion_events(spark, sf_dir)))
    return serialize.read_timelines(serialize.read_envelopes(texts)).drop("metadata")


def of_episodes(spark, sf_dir):
    return episodes(spark, sf_dir), segments.gap_sessions(emotion_events(spark, sf_dir), GAP)


def episodes_read(spark, sf_dir):
    return serialize.read_episodes(serialize.episode_payloads(*of_episodes(spark, sf_dir))).drop("metadata")


def graph_texts(spark, sf_dir):
    ep, lines = graph(spark, sf_dir)
    events = segments.gap_sessions(emotion_events(spark, sf_dir), GAP)
    return serialize.graph_payloads(ep, events, lines, graphs.graph_ids(ep, lines), NEAR)


def pictures(spark, sf_dir):
    """Three pictures for suppliers: of every fourth as posts of their own, of the others on their first posts."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_name").alias("user_id"), F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    category = F.when(F.col("k") % 4 == 0, F.element_at(F.array(F.lit("happy"), F.lit("sad"), F.lit("calm")), F.col("position") + 1))
    return rows.select("user_id", "position", F.concat(F.lit("p"), F.col("position").cast("string")).alias("image"), F.concat(F.lit("a picture of "), "user_id").alias("caption"), category.alias("category"))


def synthetic_posts(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_name").alias("user_id")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return synthetic.with_pictures(synthetic.posts(users), pictures(spark, sf_dir))


QUERIES = {
    "episode_events": inside,
    "episode_images": images,
    "timelines_read_back": timelines_read,
    "episodes_read_back": episodes_read,
    "graph_nodes_read_back": lambda s, d: serialize.read_nodes(graph_texts(s, d)),
    "graph_edges_read_back": lambda s, d: serialize.read_edges(graph_texts(s, d)),
    "synthetic_posts": synthetic_posts,
}
_ids = GRAPHS["graph_ids"].replace("SELECT n.subject_id, left(", "SELECT n.subject_id AS subject_id, left(")
_draw = lambda what, *by: f"""CAST('0x' || md5('{what}:' || {" || ':' || ".join(by)})[1:8] AS BIGINT)"""
_at = lambda what, n: f"{_draw(what, 'user_id', 'i')} % {n}"
_label = lambda w: f"CASE WHEN {_draw('label', 'user_id', 'i')} % 100 < {w[0]} THEN 'positive' WHEN {_draw('label', 'user_id', 'i')} % 100 < {w[0] + w[1]} THEN 'neutral' ELSE 'negative' END"
ORACLES = {
    "episode_events": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT subject_id, episode_index, seq FROM s2",
    "episode_images": f"""WITH {EVENTS_SQL}, {EPISODES_SQL}, p AS (SELECT subject_id, episode_index, us, seq, 'img' || seq % 5 AS image, CASE WHEN seq % 4 > 1 THEN 'caption ' || seq END AS caption FROM s2 WHERE seq % 3 = 0)
SELECT subject_id, episode_index, image, count(*) AS n, min(us) AS first_us, coalesce(CASE WHEN image = 'img1' AND subject_id % 10 < 5 AND subject_id IN (SELECT c_custkey FROM customer) THEN 'known' END, arg_min(caption, us * 1000000::HUGEINT + seq) FILTER (WHERE caption IS NOT NULL)) AS caption FROM p GROUP BY subject_id, episode_index, image""",
    "timelines_read_back": f"WITH {EVENTS_SQL} SELECT CAST(subject_id AS VARCHAR) AS subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) - 1 AS place, label AS emotion_label, score, CAST(seq AS VARCHAR) AS source_id, {iso_sql('us')} AS timestamp FROM ev",
    "episodes_read_back": f"""WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT episode_id AS fingerprint, CAST(subject_id AS VARCHAR) AS subject_id, {iso_sql('start_us')} AS start_time, {iso_sql('end_us')} AS end_time, row_number() OVER (PARTITION BY subject_id, episode_index ORDER BY us, seq) - 1 AS place,
  s2.label AS emotion_label, score, CAST(seq AS VARCHAR) AS source_id, {iso_sql('us')} AS timestamp FROM s2 JOIN episodes USING (subject_id, episode_index)""",
    "graph_nodes_read_back": f"""WITH {EVENTS_SQL}, {EPISODES_SQL}, ids AS ({_ids}) SELECT graph_id AS fingerprint, row_number() OVER (PARTITION BY subject_id ORDER BY episode_index) - 1 AS node, CAST(subject_id AS VARCHAR) AS subject_id,
  {iso_sql('start_us')} AS start_time, {iso_sql('end_us')} AS end_time, event_count FROM episodes JOIN ids USING (subject_id)""",
    "graph_edges_read_back": f"WITH ids AS ({_ids}), ed AS ({GRAPHS['narrative_edges']}) SELECT graph_id AS fingerprint, relation, source_index, target_index, 1.0::DOUBLE AS weight FROM ed JOIN ids USING (subject_id)",
    "synthetic_posts": f"""WITH u AS (SELECT c_name AS user_id FROM customer UNION SELECT s_name FROM supplier), n AS (SELECT user_id, unnest(range(20 + {_draw('posts', 'user_id')} % 21)) AS i FROM u),
p AS (SELECT user_id, 'post_' || user_id || '_' || i AS post_id, {synthetic.BASE_US} + {_at('day', 30)} * {synthetic.DAY_US} + {_at('hour', 24)} * {synthetic.HOUR_US} + {_at('minute', 60)} * 60000000 AS us, 'Sample caption ' || i || ' for ' || user_id AS caption,
  CASE WHEN contains(user_id, '001') THEN {_label((60, 30))} WHEN contains(user_id, '002') THEN {_label((20, 50))} ELSE {_label((30, 30))} END AS label, 0.5::DOUBLE + {_at('score', 500000)} / 1000000 AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, post_id) - 1 AS k, min(us) OVER (PARTITION BY user_id) AS first_us FROM p), s AS (SELECT s_name, s_suppkey, unnest(range(3)) AS k FROM supplier)
SELECT user_id, post_id, us, caption, label, score, CASE WHEN k < 3 AND user_id IN (SELECT s_name FROM supplier WHERE s_suppkey % 4 <> 0) THEN 'p' || k END AS image FROM r
UNION ALL SELECT s_name, 'post_' || s_name || '_img_' || s.k, first_us - (3 - s.k) * {synthetic.DAY_US}, 'a picture of ' || s_name, ['positive', 'negative', 'neutral'][s.k + 1], 0.9::DOUBLE, 'p' || s.k FROM s JOIN r ON r.user_id = s_name AND r.k = 0 WHERE s_suppkey % 4 = 0""",
}
