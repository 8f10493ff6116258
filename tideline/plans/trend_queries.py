"""Queries over mood trends, corrections and distances between timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import ordinal, ordinal_sql, round_up
from tideline.operators import alignment, corrections, trends
from tideline.operators.signatures import DIMENSIONS
from tideline.plans.timelines import DAY
from tideline.sources.adapters import EVENTS_SQL, emotion_events

MOOD = ordinal_sql("label")
NOW = 1_706_000_000_000_000


def mood(spark, sf_dir):
    """The score of errors is unknown, to have nulls in the series."""
    e = emotion_events(spark, sf_dir)
    return e.withColumn("mood", F.when(F.col("event_type") != "signup", ordinal(F.col("label"))))


MOOD_SQL = f"m AS (SELECT *, CASE WHEN event_type <> 'signup' THEN {MOOD} END AS mood FROM ev)"


#: The stated subjects of a distance matrix: their rows of it, against all subjects.
STATED = "subject_id % 100 = 0"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def pair_distance(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    return alignment.pair_distance(e, F.expr(STATED), DAY).select("a", "b", "window_count", *(round_up(F.col(c), 6).alias(c) for c in ("mean_abs_difference", "sum_squared_difference")), "windows_a", "windows_b", "windows_both")


def presence(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    return alignment.with_diagonal(alignment.presence_distance(e, F.expr(STATED), DAY), e.filter(STATED).select("subject_id").distinct())


def fixes(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    return e.select("subject_id", F.pmod("seq", F.lit(7)).alias("post_id"), "us", "seq", "label")


def queue(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    status = F.element_at(F.array(F.lit("pending"), F.lit("processing"), F.lit("done")), (F.pmod("seq", F.lit(3)) + 1).cast("int"))
    got = corrections.claim(e.select("seq", "us", status.alias("status"), F.when(F.pmod("seq", F.lit(3)) == 1, F.col("us")).alias("claimed_us")), NOW)
    return got.withColumn("claimed_us", F.coalesce("claimed_us", F.lit(0)))


def chime(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    names = F.array(*map(F.lit, DIMENSIONS))
    pick = lambda m: F.element_at(names, (F.pmod(F.col("seq") * m, F.lit(5)) + 1).cast("int"))
    fixed = F.when(F.pmod("seq", F.lit(4)) == 0, F.upper(pick(3))).when(F.pmod("seq", F.lit(4)) == 1, "")
    return trends.chime_counts(e.select("subject_id", pick(1).alias("predicted_label"), fixed.alias("corrected_label")), list(DIMENSIONS))


QUERIES = {
    "mood_cumsum": lambda s, d: trends.cumulative(mood(s, d), F.col("mood")).select("subject_id", "seq", "cumulative"),
    "mood_rolling5": lambda s, d: trends.rolling_mean(mood(s, d), F.col("mood")).select("subject_id", "seq", *r6("rolling")),
    "mood_ema5": lambda s, d: trends.exponential_mean(emotion_events(s, d), ordinal(F.col("label"))).select("subject_id", "seq", *r6("ema")),
    "latest_event": lambda s, d: trends.latest(emotion_events(s, d), "seq", "us", "label"),
    "chime_counts": chime,
    "timeline_pair_distance": pair_distance,
    "presence_distance_matrix": presence,
    "correction_rate_limit": lambda s, d: corrections.rate_limited(emotion_events(s, d), 2, 12 * corrections.HOUR_US).select("subject_id", "seq", "in_last_hour", "allowed"),
    "latest_correction": lambda s, d: corrections.latest_correction(fixes(s, d)),
    "fl_queue_claim": queue,
}
_pairs = f"""e AS (SELECT * FROM ev), b AS (SELECT subject_id, min(us) AS lo FROM e GROUP BY subject_id),
pr AS (SELECT x.subject_id AS a, y.subject_id AS b, least(x.lo, y.lo) AS anchor FROM b x JOIN b y ON x.subject_id % 100 = 0 AND x.subject_id <> y.subject_id),
sd AS (SELECT a, b, 'a' AS side, CAST(floor((us - anchor) / {DAY}::DOUBLE) AS BIGINT) AS w, label FROM pr JOIN e ON subject_id = a UNION ALL SELECT a, b, 'b', CAST(floor((us - anchor) / {DAY}::DOUBLE) AS BIGINT), label FROM pr JOIN e ON subject_id = b)"""
_pick = lambda m: "['" + "', '".join(DIMENSIONS) + f"'][(seq * {m}) % 5 + 1]"
ORACLES = {
    "mood_cumsum": f"WITH {EVENTS_SQL}, {MOOD_SQL} SELECT subject_id, seq, CASE WHEN mood IS NOT NULL THEN sum(mood) OVER (PARTITION BY subject_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) END AS cumulative FROM m",
    "mood_rolling5": f"WITH {EVENTS_SQL}, {MOOD_SQL} SELECT subject_id, seq, round(avg(mood) OVER (PARTITION BY subject_id ORDER BY us, seq ROWS 4 PRECEDING), 6) AS rolling FROM m",
    "mood_ema5": f"""WITH RECURSIVE {EVENTS_SQL}, i AS (SELECT subject_id, seq, {MOOD} AS v, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) AS k FROM ev),
r AS (SELECT subject_id, seq, k, v AS y FROM i WHERE k = 1 UNION ALL SELECT i.subject_id, i.seq, i.k, r.y * (2.0::DOUBLE / 3) + i.v / 3.0::DOUBLE FROM r JOIN i ON i.subject_id = r.subject_id AND i.k = r.k + 1) SELECT subject_id, seq, round(y, 6) AS ema FROM r""",
    "latest_event": f"WITH {EVENTS_SQL} SELECT subject_id, arg_max(seq, us) AS seq, max(us) AS us, arg_max(label, us) AS label FROM ev GROUP BY subject_id",
    "chime_counts": f"WITH {EVENTS_SQL}, l AS (SELECT subject_id, CASE seq % 4 WHEN 0 THEN {_pick(3)} ELSE {_pick(1)} END AS l FROM ev) SELECT subject_id, " + ", ".join(f"count(*) FILTER (WHERE l = '{x}') AS \"{x}\"" for x in DIMENSIONS) + " FROM l GROUP BY subject_id",
    "timeline_pair_distance": f"""WITH {EVENTS_SQL}, {_pairs}, p AS (SELECT a, b, w, avg({MOOD}) FILTER (WHERE side = 'a') AS x, avg({MOOD}) FILTER (WHERE side = 'b') AS y FROM sd GROUP BY ALL)
SELECT a, b, max(w) - min(w) + 1 AS window_count, round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / (max(w) - min(w) + 1), 6) AS mean_abs_difference, round(sum(pow(coalesce(x, 0) - coalesce(y, 0), 2)), 6) AS sum_squared_difference,
  count(x) AS windows_a, count(y) AS windows_b, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS windows_both FROM p GROUP BY a, b""",
    "presence_distance_matrix": f"""WITH {EVENTS_SQL}, {_pairs}, p AS (SELECT a, b, w, count(DISTINCT side) AS n FROM sd GROUP BY ALL), q AS (SELECT a, b, count(*) FILTER (WHERE n = 1) AS distance FROM p GROUP BY a, b)
SELECT * FROM q UNION ALL SELECT DISTINCT subject_id, subject_id, 0 FROM e WHERE subject_id % 100 = 0""",
    "correction_rate_limit": f"""WITH RECURSIVE {EVENTS_SQL}, i AS (SELECT subject_id, seq, us, row_number() OVER (PARTITION BY subject_id ORDER BY us, seq) AS k FROM ev),
r AS (SELECT subject_id, seq, k, 0::BIGINT AS n, [us] AS kept FROM i WHERE k = 1
  UNION ALL SELECT i.subject_id, i.seq, i.k, len(z.l)::BIGINT, CASE WHEN len(z.l) < 2 THEN list_append(z.l, i.us) ELSE z.l END FROM r JOIN i ON i.subject_id = r.subject_id AND i.k = r.k + 1, LATERAL (SELECT list_filter(r.kept, lambda t: t >= i.us - 43200000000) AS l) z)
SELECT subject_id, seq, n AS in_last_hour, n < 2 AS allowed FROM r""",
    "latest_correction": f"WITH {EVENTS_SQL} SELECT subject_id, seq % 7 AS post_id, arg_max(label, us) AS label, count(*) AS history FROM ev GROUP BY ALL",
    "fl_queue_claim": f"""WITH {EVENTS_SQL}, p AS (SELECT seq, us, ['pending', 'processing', 'done'][seq % 3 + 1] AS st, CASE WHEN seq % 3 = 1 THEN us END AS claimed_us FROM ev), q AS (SELECT seq, us, CASE WHEN st = 'processing' AND claimed_us < {NOW - corrections.HOUR_US} THEN 'pending' ELSE st END AS st, claimed_us FROM p),
t AS (SELECT seq FROM q WHERE st = 'pending' ORDER BY us, seq LIMIT 50), k AS (SELECT count(*) >= 50 AS ready FROM q WHERE st = 'pending')
SELECT seq, us, CASE WHEN ready AND seq IN (SELECT seq FROM t) THEN 'processing' ELSE st END AS status, CASE WHEN ready AND seq IN (SELECT seq FROM t) THEN {NOW} ELSE coalesce(claimed_us, 0) END AS claimed_us FROM q, k""",
}
