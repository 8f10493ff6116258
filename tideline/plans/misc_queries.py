"""Queries over frames, input checks, keyword vectors, serialised graphs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.functions.scalars import iso
from tideline.operators import documents as D, frames as FR, integrity as I, keywords as K
from tideline.plans.timelines import DAY, EPISODES_SQL, GAP, HOUR, episodes
from tideline.sources import store, tables
from tideline.sources.adapters import EVENTS_SQL, emotion_events, sentiment, table
from tideline.streaming import online

AS_OF = 1_706_000_000_000_000
SIZE = 36 * HOUR


def frames(spark, sf_dir):
    """Three estimates per event from its id and value, scaled to one."""
    e = emotion_events(spark, sf_dir)
    raw = {"positive": F.pmod("seq", F.lit(7)) + 1, "neutral": F.pmod("seq", F.lit(5)) + 1, "negative": F.pmod(F.floor("value"), F.lit(6)) + 1}
    total = raw["positive"] + raw["neutral"] + raw["negative"]
    return e.select("subject_id", "us", "seq", *((v / total).alias(k) for k, v in raw.items()), (F.pmod("seq", F.lit(30)) / 100.0).alias("uncertainty"), F.col("seq").cast("string").alias("source_id"))


FRAMES_SQL = """f0 AS (SELECT subject_id, us, seq, seq % 7 + 1 AS a, seq % 5 + 1 AS b, CAST(floor(value) AS BIGINT) % 6 + 1 AS c, seq % 30 / 100.0::DOUBLE AS u FROM ev),
fr AS (SELECT subject_id, us, seq, a / (a + b + c) AS positive, b / (a + b + c) AS neutral, c / (a + b + c) AS negative, u FROM f0)"""


def derived(spark, sf_dir):
    got = FR.derived(frames(spark, sf_dir))
    return got.select("subject_id", "seq", F.round("confidence", 6).alias("confidence"), "dominant", F.round("dominant_probability", 6).alias("dominant_probability"))


def flips(spark, sf_dir):
    e = emotion_events(spark, sf_dir).withColumn("window_index", F.col("us"))
    return FR.flip_flops(e).select("subject_id", "seq", "flip_flop")


def samples(spark, sf_dir):
    """Arrays of entries with a time each: a subject's events in the order of a shuffled index."""
    e = emotion_events(spark, sf_dir)
    return e.withColumn("index", F.col("seq") + F.pmod("seq", F.lit(3)) * 40)


def all_issues(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    place = F.concat(F.lit("event "), F.col("seq").cast("string"))
    fields = [I.Field("seq"), I.Field("label", pattern="^(positive|neutral|negative)$"), I.Field("value", least=1.0)]
    return I.order_issues(samples(spark, sf_dir), "subject_id", "index", "us").union(I.future_issues(e, "us", AS_OF, place)).union(I.schema_issues(e, fields, place)).union(paths(spark, sf_dir))


def paths(spark, sf_dir):
    """Page addresses and, for every third page, a local name; those of even pages exist."""
    p = table(spark, sf_dir, "pages")
    local = F.concat(F.lit("media/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    rows = p.select("page_id", F.when(F.pmod("page_id", F.lit(3)) == 0, local).when(F.pmod("page_id", F.lit(3)) == 1, F.col("url")).otherwise("").alias("p"))
    existing = p.filter("page_id % 2 = 0").select(local.alias("path"))
    return I.path_issues(rows, "p", existing, F.concat(F.lit("page "), F.col("page_id").cast("string")))


def parsed(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    form = F.pmod("seq", F.lit(3))
    text = F.when(form == 0, F.concat(iso(F.col("us")), F.lit("Z"))).when(form == 1, F.floor(F.col("us") / 1_000_000).cast("string")).otherwise(F.floor(F.col("us") / 1000).cast("string"))
    return e.select("seq", F.unix_millis(I.parse_timestamp(text)).alias("millis"))


def leaves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"samples":[{"meta":'), F.col("props"), F.lit(',"timestamp":"t'), F.col("event_type"), F.lit('"},"x"]}')).alias("doc"))
    found = D.walk(e, "event_id", "doc")
    return found.filter(~F.col("kind").isin("object", "array")).select("event_id", "path", "name", "value")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("user_id"), "vec_id", "embedding")


def stream_events(spark, sf_dir):
    """The events as a stream of files, with a far later sentinel that closes all windows."""
    folder = f"{tables.scratch(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), sentiment(F.col("event_type")).alias("label"))
    e.write.parquet(f"{folder}/in/part=0")
    spark.createDataFrame([(-1, "2030-01-01 00:00:00", "neutral")], "subject_id long, ts string, label string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{folder}/in/part=1")
    read = spark.readStream.schema("subject_id long, ts timestamp, label string, part int").option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    return read.drop("part"), folder


def stream_sessions(spark, sf_dir):
    stream, folder = stream_events(spark, sf_dir)
    return online.run_to_end(online.session_episodes(stream, f"{GAP // 1_000_000} seconds", "1 hour"), folder).filter("subject_id >= 0")


def stream_scores(spark, sf_dir):
    stream, folder = stream_events(spark, sf_dir)
    got = online.run_to_end(online.window_scores(stream, "1 day", "1 hour"), folder).filter("subject_id >= 0")
    return got.select("subject_id", "start_us", F.round("window_score", 6).alias("window_score"), "event_count")


def lists(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.cluster_keyword_lists(e.select(F.when(F.pmod("vec_id", F.lit(2)) == 0, "positive").otherwise("negative").alias("sentiment"), (F.col("label") - 1).alias("cluster"), F.concat(F.lit("k"), F.pmod("vec_id", F.lit(9)).cast("string")).alias("keyword")))


def stored(spark, sf_dir):
    """Episode payloads by fingerprint, after two puts of overlapping halves."""
    rows = episodes(spark, sf_dir).select(F.col("episode_id").alias("fingerprint"), F.to_json(F.struct(F.col("dominant_label"), F.col("event_count"), F.col("start_us"))).alias("data_json"))
    got = store.get_or_compute(None, rows.filter("fingerprint < '9'"), lambda missing: missing)
    return store.get_or_compute(got, rows, lambda missing: missing).select("fingerprint", F.get_json_object("data_json", "$.event_count").cast("long").alias("event_count"))


QUERIES = {
    "frame_windows": lambda s, d: FR.greedy_windows(frames(s, d), SIZE),
    "frame_weighted_probabilities": lambda s, d: FR.weighted_probabilities(frames(s, d), "subject_id").select("subject_id", *(F.round(c, 6).alias(c) for c in FR.CLASSES)),
    "frame_derived": derived,
    "frame_timeline": lambda s, d: FR.frame_timeline(frames(s, d), SIZE),
    "flip_flops": flips,
    "temporal_order_issues": lambda s, d: I.order_issues(samples(s, d), "subject_id", "index", "us"),
    "future_timestamp_issues": lambda s, d: I.future_issues(emotion_events(s, d), "us", AS_OF, F.col("seq").cast("string")),
    "path_issues": paths,
    "schema_issues": lambda s, d: I.schema_issues(emotion_events(s, d), [I.Field("seq"), I.Field("label", pattern="^(positive|neutral)$"), I.Field("value", least=1.0)], F.col("seq").cast("string")),
    "severity_counts": lambda s, d: I.severity_counts(all_issues(s, d)),
    "parsed_timestamps": parsed,
    "json_leaves": leaves,
    "remote_urls": lambda s, d: table(s, d, "pages").select("page_id", I.is_remote(F.col("url")).alias("remote")),
    "keyword_clusters": lambda s, d: K.keyword_clusters(vectors(s, d)),
    "cluster_keyword_lists": lists,
    "stored_payloads": stored,
    "stream_session_episodes": stream_sessions,
    "stream_window_scores": stream_scores,
}
_issue = lambda sev, cat, msg, loc: f"'{sev}' AS severity, '{cat}' AS category, {msg} AS message, {loc} AS location"
ORDER_SQL = f"o AS (SELECT subject_id, us, seq + seq % 3 * 40 AS k, lag(us) OVER (PARTITION BY subject_id ORDER BY seq + seq % 3 * 40) AS b FROM ev), oi AS (SELECT {_issue('ERROR', 'temporal', chr(39) + 'out of order' + chr(39), chr(39) * 2 + ' || subject_id || ' + chr(39) + '[' + chr(39) + ' || k || ' + chr(39) + ']' + chr(39))} FROM o WHERE b > us)"
_local = "'media/' || page_id || '.jpg'"
PATHS_SQL = f"""pp AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_local} WHEN 1 THEN url ELSE '' END AS p FROM pages), ps AS (SELECT page_id, CASE WHEN trim(p) = '' THEN 'WARNING' WHEN regexp_matches(lower(p), '^(https?|s3|ftp)://') THEN 'INFO' WHEN p NOT IN (SELECT {_local} FROM pages WHERE page_id % 2 = 0) THEN 'ERROR' END AS severity, p FROM pp),
pi AS (SELECT severity, 'path' AS category, CASE severity WHEN 'WARNING' THEN 'empty path' WHEN 'INFO' THEN 'remote path' ELSE 'missing file' END AS message, 'page ' || page_id AS location FROM ps WHERE severity IS NOT NULL)"""
ORACLES = {
    "frame_windows": f"""WITH RECURSIVE {EVENTS_SQL}, i AS (SELECT subject_id, seq, us, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) AS k FROM ev),
r AS (SELECT subject_id, seq, k, us AS start, 0::BIGINT AS w FROM i WHERE k = 1 UNION ALL SELECT i.subject_id, i.seq, i.k, CASE WHEN i.us - r.start >= {SIZE} THEN i.us ELSE r.start END, r.w + CASE WHEN i.us - r.start >= {SIZE} THEN 1 ELSE 0 END FROM r JOIN i ON i.subject_id = r.subject_id AND i.k = r.k + 1) SELECT subject_id, seq, w AS window_index FROM r""",
    "frame_weighted_probabilities": f"WITH {EVENTS_SQL}, {FRAMES_SQL} SELECT subject_id, round(sum(positive * (1 - u)) / sum(1 - u), 6) AS positive, round(sum(neutral * (1 - u)) / sum(1 - u), 6) AS neutral, round(sum(negative * (1 - u)) / sum(1 - u), 6) AS negative FROM fr GROUP BY subject_id",
    "frame_derived": f"WITH {EVENTS_SQL}, {FRAMES_SQL}, g AS (SELECT *, greatest(positive, neutral, negative) AS t FROM fr) SELECT subject_id, seq, round(1 - u, 6) AS confidence, CASE WHEN positive = t THEN 'positive' WHEN neutral = t THEN 'neutral' ELSE 'negative' END AS dominant, round(t, 6) AS dominant_probability FROM g",
    "flip_flops": f"WITH {EVENTS_SQL}, l AS (SELECT subject_id, seq, label, lag(label) OVER w AS a, lead(label) OVER w AS b FROM ev WINDOW w AS (PARTITION BY subject_id ORDER BY us)) SELECT subject_id, seq, coalesce(a = b AND label <> a, false) AS flip_flop FROM l",
    "temporal_order_issues": f"WITH {EVENTS_SQL}, {ORDER_SQL} SELECT * FROM oi",
    "future_timestamp_issues": f"WITH {EVENTS_SQL} SELECT {_issue('ERROR', 'temporal', chr(39) + 'timestamp in the future' + chr(39), 'CAST(seq AS VARCHAR)')} FROM ev WHERE us > {AS_OF}",
    "path_issues": f"WITH {PATHS_SQL} SELECT * FROM pi",
    "schema_issues": f"WITH {EVENTS_SQL} SELECT {_issue('ERROR', 'schema', chr(39) + 'label has a wrong form' + chr(39), 'CAST(seq AS VARCHAR)')} FROM ev WHERE label = 'negative' UNION ALL SELECT {_issue('ERROR', 'schema', chr(39) + 'value is too small' + chr(39), 'CAST(seq AS VARCHAR)')} FROM ev WHERE value < 1",
    "severity_counts": f"""WITH {EVENTS_SQL}, {ORDER_SQL}, {PATHS_SQL}, a AS (SELECT severity FROM oi UNION ALL SELECT severity FROM pi UNION ALL SELECT 'ERROR' FROM ev WHERE us > {AS_OF} UNION ALL SELECT 'ERROR' FROM ev WHERE value < 1)
SELECT count(*) FILTER (WHERE severity = 'ERROR') AS error, count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'INFO') AS info, coalesce(bool_or(severity = 'ERROR'), false) AS has_errors FROM a""",
    "parsed_timestamps": f"WITH {EVENTS_SQL} SELECT seq, CASE WHEN seq % 3 = 1 THEN us // 1000000 * 1000 ELSE us // 1000 END AS millis FROM ev",
    "json_leaves": """SELECT event_id, 'samples[0].meta.k' AS path, 'k' AS name, props ->> '$.k' AS value FROM events UNION ALL SELECT event_id, 'samples[0].timestamp', 'timestamp', 't' || event_type FROM events UNION ALL SELECT event_id, 'samples[1]', 'samples', 'x' FROM events""",
    "remote_urls": "SELECT page_id, regexp_matches(lower(url), '^(https?|s3|ftp)://') AS remote FROM pages",
    "cluster_keyword_lists": "SELECT CASE WHEN vec_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment, CASE WHEN label = 0 THEN 'noise' ELSE CAST(label - 1 AS VARCHAR) END AS cluster, string_agg(DISTINCT 'k' || (vec_id % 9), ',' ORDER BY 'k' || (vec_id % 9)) AS keywords FROM embeddings GROUP BY 1, 2",
    "stored_payloads": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT episode_id AS fingerprint, event_count FROM episodes",
    "stream_session_episodes": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT subject_id, start_us, last_us, event_count FROM episodes",
    "stream_window_scores": f"WITH {EVENTS_SQL} SELECT subject_id, us // {DAY} * {DAY} AS start_us, round(avg(CASE label WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS window_score, count(*) AS event_count FROM ev GROUP BY ALL",
}
