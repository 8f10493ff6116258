"""Queries over timelines, windows and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import iso_sql, ordinal_sql
from tideline.operators import segments, timeline
from tideline.sources.adapters import EVENTS_SQL, emotion_events

HOUR = 3_600_000_000
GAP, DAY = 6 * HOUR, 24 * HOUR
SECONDS = lambda x: f"CAST(({x}) // 1000000 AS VARCHAR) || '.' || lpad(CAST(({x}) % 1000000 AS VARCHAR), 6, '0')"

EPISODES_SQL = f"""s1 AS (SELECT *, CASE WHEN us - lag(us) OVER w > {GAP} THEN 1 ELSE 0 END AS opens FROM ev WINDOW w AS (PARTITION BY subject_id ORDER BY us, seq)),
s2 AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY subject_id ORDER BY us, seq) AS BIGINT) AS episode_index FROM s1),
s3 AS (SELECT subject_id, episode_index, label, count(*) AS n, min(us) AS first_us, min(seq) AS first_seq FROM s2 GROUP BY ALL),
s4 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, episode_index ORDER BY n DESC, first_us, first_seq) AS r FROM s3),
s5 AS (SELECT subject_id, episode_index, min(us) AS start_us, max(us) AS last_us, count(*) AS event_count FROM s2 GROUP BY ALL),
s6 AS (SELECT s5.*, label AS dominant_label, last_us + CASE WHEN sum(event_count) OVER (PARTITION BY subject_id) = 1 THEN 1 ELSE 1000000 END AS end_us FROM s5 JOIN s4 USING (subject_id, episode_index) WHERE r = 1),
episodes AS (SELECT *, left(sha256(subject_id || ':' || {iso_sql('start_us')} || ':' || {iso_sql('end_us')}), 32) AS episode_id FROM s6)"""
GAPS_SQL = "g AS (SELECT *, us - lag(us) OVER (PARTITION BY subject_id ORDER BY us, seq) AS gap_us FROM ev)"


def episodes(spark, sf_dir):
    return segments.gap_episodes(emotion_events(spark, sf_dir), GAP)


def windows_of(spark, sf_dir):
    return segments.fixed_windows(emotion_events(spark, sf_dir), DAY)


WINDOWS_SQL = f"w AS (SELECT *, CAST(floor((us - min(us) OVER (PARTITION BY subject_id)) / {DAY}::DOUBLE) AS BIGINT) AS window_index FROM ev)"
SCORES_SQL = f"sc AS (SELECT subject_id, window_index, avg({ordinal_sql('label')}) AS window_score, count(*) AS event_count FROM w GROUP BY ALL)"
JANUARY = 1_704_067_200_000_000


def given_windows(spark, sf_dir):
    weeks = spark.createDataFrame([(i, JANUARY + 7 * i * DAY, JANUARY + 7 * (i + 1) * DAY) for i in range(5)], "window_index long, start_us long, end_us long")
    return segments.align_to_windows(emotion_events(spark, sf_dir), weeks)


QUERIES = {
    "timeline_bounds": lambda s, d: timeline.bounds(emotion_events(s, d)),
    "timeline_gaps": lambda s, d: timeline.gaps(emotion_events(s, d)).select("subject_id", "seq", "gap_us"),
    "timeline_index": lambda s, d: timeline.build_timeline(emotion_events(s, d)).select("subject_id", "seq", "event_index"),
    "timeline_order_violations": lambda s, d: timeline.order_violations(emotion_events(s, d)).select("subject_id", "seq", "us", "previous_us"),
    "timeline_fingerprint": lambda s, d: timeline.structural_fingerprint(emotion_events(s, d)),
    "timeline_csv_rows": lambda s, d: timeline.csv_rows(emotion_events(s, d)),
    "timeline_summary": lambda s, d: timeline.summary(emotion_events(s, d)),
    "label_ordinal_window_mean": lambda s, d: segments.window_scores(windows_of(s, d)).select("subject_id", "window_index", F.round("window_score", 6).alias("window_score"), "event_count"),
    "score_window_mean": lambda s, d: segments.window_scores(windows_of(s, d), True).select("subject_id", "window_index", F.round("window_score", 6).alias("window_score")),
    "window_score_self_similarity": lambda s, d: segments.self_similarity(segments.window_scores(windows_of(s, d))).select(
        "subject_id", F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"), F.round("variance", 6).alias("variance"), "window_count", "event_count"),
    "fixed_windows_dense": lambda s, d: segments.dense_windows(emotion_events(s, d), DAY),
    "align_to_given_windows": given_windows,
    "align_timelines_first_event": lambda s, d: segments.align_first_event(emotion_events(s, d), DAY).fillna(-1, ["seq"]),
    "align_timelines_end_anchor": lambda s, d: segments.align_first_event(emotion_events(s, d), DAY, "end").fillna(-1, ["seq"]),
    "align_timelines_explicit_anchor": lambda s, d: segments.align_first_event(emotion_events(s, d), DAY, "explicit", JANUARY + 10 * DAY).fillna(-1, ["seq"]),
    "gap_episodes": lambda s, d: episodes(s, d).select("subject_id", "episode_index", "start_us", "end_us", "event_count"),
    "episode_ids": lambda s, d: episodes(s, d).select("subject_id", "episode_index", "episode_id"),
    "episode_dominant_label": lambda s, d: episodes(s, d).select("subject_id", "episode_index", "dominant_label"),
}


def _aligned(base: str, extra: str = "") -> str:
    return f"""WITH {EVENTS_SQL}, ends AS (SELECT min(us) AS lo, max(us) AS hi FROM ev), b AS (SELECT *, {base} AS base FROM ends), n AS (SELECT base, greatest(1, CAST(floor((hi - base) / {DAY}::DOUBLE) AS BIGINT) + 1) AS n FROM b),
grid AS (SELECT subject_id, unnest(range(0, n)) AS window_index FROM (SELECT DISTINCT subject_id FROM ev), n),
f AS (SELECT subject_id, CAST(floor((us - base) / {DAY}::DOUBLE) AS BIGINT) AS window_index, seq, label, us FROM ev, n WHERE us >= base),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, window_index ORDER BY us, seq) AS k FROM f)
SELECT grid.subject_id, grid.window_index, coalesce(seq, -1) AS seq, label FROM grid LEFT JOIN r ON grid.subject_id = r.subject_id AND grid.window_index = r.window_index AND k = 1"""


ORACLES = {
    "timeline_bounds": f"WITH {EVENTS_SQL} SELECT subject_id, count(*) AS event_count, min(us) AS start_us, max(us) AS end_us, CASE WHEN count(*) < 2 THEN 0.0 ELSE (max(us) - min(us)) / 1e6 END AS duration, CASE WHEN count(*) >= 2 THEN (max(us) - min(us)) / 1e6 END AS time_span FROM ev GROUP BY subject_id",
    "timeline_gaps": f"WITH {EVENTS_SQL}, {GAPS_SQL} SELECT subject_id, seq, gap_us FROM g WHERE gap_us IS NOT NULL",
    "timeline_index": f"WITH {EVENTS_SQL} SELECT subject_id, seq, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) - 1 AS event_index FROM ev",
    "timeline_order_violations": f"WITH {EVENTS_SQL}, p AS (SELECT subject_id, seq, us, lag(us) OVER (PARTITION BY subject_id ORDER BY seq) AS previous_us FROM ev) SELECT * FROM p WHERE previous_us > us",
    "timeline_fingerprint": f"""WITH {EVENTS_SQL}, {GAPS_SQL}, p AS (SELECT subject_id, count(*) AS n, max(us) - min(us) AS span, coalesce(string_agg({SECONDS('gap_us')}, '' ORDER BY us, seq) FILTER (WHERE gap_us IS NOT NULL), '') AS t FROM g GROUP BY subject_id)
SELECT subject_id, left(sha256(n || ':' || {SECONDS('span')} || ':' || left(sha256(t), 16)), 32) AS fingerprint FROM p""",
    "timeline_csv_rows": f"WITH {EVENTS_SQL} SELECT subject_id, {iso_sql('us')} AS timestamp, label AS emotion_label, score, CAST(seq AS VARCHAR) AS source_id FROM ev",
    "timeline_summary": f"""WITH {EVENTS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) - 1 AS i FROM ev), p AS (SELECT subject_id, count(*) AS event_count, min(us) AS a, max(us) AS b, string_agg(i || ':' || {iso_sql('us')} || ':' || label, ',' ORDER BY i) AS events FROM i GROUP BY subject_id)
SELECT subject_id, event_count, (b - a) / 1e6 AS span_seconds, {iso_sql('a')} AS first, {iso_sql('b')} AS last, events FROM p""",
    "label_ordinal_window_mean": f"WITH {EVENTS_SQL}, {WINDOWS_SQL}, {SCORES_SQL} SELECT subject_id, window_index, round(window_score, 6) AS window_score, event_count FROM sc",
    "score_window_mean": f"WITH {EVENTS_SQL}, {WINDOWS_SQL} SELECT subject_id, window_index, round(avg(score), 6) AS window_score FROM w GROUP BY ALL",
    "window_score_self_similarity": f"WITH {EVENTS_SQL}, {WINDOWS_SQL}, {SCORES_SQL} SELECT subject_id, round(min(window_score), 6) AS min_score, round(max(window_score), 6) AS max_score, round(var_pop(window_score), 6) AS variance, count(*) AS window_count, CAST(sum(event_count) AS BIGINT) AS event_count FROM sc GROUP BY subject_id",
    "fixed_windows_dense": f"""WITH {EVENTS_SQL}, {WINDOWS_SQL}, c AS (SELECT subject_id, window_index, count(*) AS n FROM w GROUP BY ALL), sp AS (SELECT subject_id, a, unnest(range(0, k + 1)) AS window_index FROM (SELECT subject_id, min(us) AS a, max(window_index) AS k FROM w GROUP BY subject_id))
SELECT subject_id, window_index, a + window_index * {DAY} AS start_us, a + (window_index + 1) * {DAY} AS end_us, coalesce(n, 0) AS event_count FROM sp LEFT JOIN c USING (subject_id, window_index)""",
    "align_to_given_windows": f"""WITH {EVENTS_SQL}, k AS (SELECT unnest(range(0, 5)) AS window_index), g AS (SELECT subject_id, window_index FROM (SELECT DISTINCT subject_id FROM ev), k),
c AS (SELECT subject_id, (us - {JANUARY}) // {7 * DAY} AS window_index, count(*) AS n, arg_min(label, us) AS first_label FROM ev WHERE us >= {JANUARY} AND us < {JANUARY + 35 * DAY} GROUP BY ALL)
SELECT subject_id, window_index, coalesce(n, 0) AS event_count, first_label FROM g LEFT JOIN c USING (subject_id, window_index)""",
    "align_timelines_first_event": _aligned("lo"),
    "align_timelines_end_anchor": _aligned(f"hi - CAST(ceil((hi - lo) / {DAY}::DOUBLE) AS BIGINT) * {DAY}"),
    "align_timelines_explicit_anchor": _aligned(str(JANUARY + 10 * DAY)),
    "gap_episodes": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT subject_id, episode_index, start_us, end_us, event_count FROM episodes",
    "episode_ids": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT subject_id, episode_index, episode_id FROM episodes",
    "episode_dominant_label": f"WITH {EVENTS_SQL}, {EPISODES_SQL} SELECT subject_id, episode_index, dominant_label FROM episodes",
}
