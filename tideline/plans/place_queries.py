"""Queries over places, signatures and location sentiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import round_up
from tideline.operators import places as P, signatures as S
from tideline.sources import tables
from tideline.sources.adapters import LOCATIONS_SQL, PLACES_SQL, VISITS_SQL, location_sentiments, place_visits, places

METRES, CLUSTER_M = 300_000.0, 60_000.0
AS_OF = 1_706_000_000_000_000
DIM = S.DIMENSIONS
r6 = lambda *names: [(F.round(n, 6) + 0.0).alias(n) for n in names]
p6 = lambda *names: [round_up(F.col(n), 6).alias(n) for n in names]


def pairs(spark, sf_dir, parts=None):
    """Places whose id is divisible by 100 with all places."""
    p = places(spark, sf_dir)
    return P.place_pairs(p.filter("place_id % 100 = 0"), p, parts)


def scored(spark, sf_dir):
    return pairs(spark, sf_dir, P.attributes).withColumn("proximity", P.composite(*(F.col(c) for c in P.WEIGHTS)))


def nearby(spark, sf_dir):
    p = places(spark, sf_dir)
    return P.nearby(p.filter("place_id % 100 = 0").withColumnRenamed("place_id", "target_id"), p, METRES).select("target_id", "place_id", F.round("distance_m", 3).alias("distance_m"))


#: Weightings of the geographic, categorical, linguistic and cultural parts.
SCENARIOS = {
    "Default": (0.3, 0.4, 0.15, 0.15),
    "Geographic Focus": (0.7, 0.2, 0.05, 0.05),
    "Categorical Focus": (0.1, 0.7, 0.1, 0.1),
    "Cultural Focus": (0.1, 0.2, 0.2, 0.5),
    "Equal Weights": (0.25, 0.25, 0.25, 0.25),
}


def sensitivity(spark, sf_dir):
    """Mean proximity by scenario, for pairs of equal and of different types: a composite is linear in its parts, so the
    means of the four parts give that of every scenario."""
    parts = ("geographic", "categorical", "linguistic", "cultural")
    known = places(spark, sf_dir).withColumn("type", P.plain(F.col("type")))
    asked = known.filter("place_id % 100 = 0")
    sums = P.group_sums(asked, known.withColumn("near_type", F.col("type")), "near_type").join(asked.select("place_id", "type"), "place_id")
    base = sums.groupBy((F.col("type") == F.col("near_type")).alias("same_type")).agg(*((F.sum(c) / F.sum("n")).alias(c) for c in parts))
    got = base.select("same_type", *(P.composite(*(F.col(c) for c in parts), dict(zip(P.WEIGHTS, w, strict=True))).alias(k) for k, w in SCENARIOS.items()))
    return got.unpivot(["same_type"], list(SCENARIOS), "scenario", "mean_proximity").select("same_type", "scenario", *r6("mean_proximity"))


def types(spark, sf_dir):
    return places(spark, sf_dir).select(F.col("place_id").alias("location_id"), "type")


def semantic_dbscan(spark, sf_dir):
    """Links are pairs with a proximity of .68 and more, between any places."""
    return P.semantic_clusters(places(spark, sf_dir), 0.68, 2, tables.cut)


def cluster_quality(spark, sf_dir):
    """Silhouettes of the places whose id is divisible by 100 against all clustered places."""
    found = tables.cut(semantic_dbscan(spark, sf_dir).filter("cluster_id <> -1"))
    known = places(spark, sf_dir).join(found, "place_id")
    sums = P.group_sums(known.filter("place_id % 100 = 0"), known, "cluster_id").withColumnRenamed("cluster_id", "cb")
    distance = 1 - P.composite(*(F.col(c) / F.col("n") for c in P.WEIGHTS))
    own = found.select(F.col("place_id").alias("a"), F.col("cluster_id").alias("ca"))
    far = sums.select(F.col("place_id").alias("a"), "cb", distance.alias("distance")).join(own, "a")
    return P.silhouette_within(far).groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def cluster_index(spark, sf_dir):
    """Davies-Bouldin of the geographic clusters."""
    got = P.geo_clusters(places(spark, sf_dir), CLUSTER_M, tables.cut).join(places(spark, sf_dir), "place_id")
    return P.davies_bouldin(got.select("cluster_id", F.col("lat").alias("x"), F.col("lon").alias("y"))).select(*r6("davies_bouldin"))


def notebook_pairs(spark, sf_dir):
    """The variant with kilometres by the arc sine and a linear decay."""
    got, km = pairs(spark, sf_dir), P.arc_sine_km(F.col("haversine"))
    return got.select("place_id_a", "place_id_b", round_up(km, 6).alias("km"), round_up(P.linear_decay(km, 2000.0), 6).alias("linear"))


def pearson(spark, sf_dir):
    """Correlation of the score with the order's place in time, over all entries."""
    return location_sentiments(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.corr("score", F.col("us") / 86_400_000_000), 6).alias("r"))


def added(spark, sf_dir):
    """Entries with one added for each place."""
    entries = location_sentiments(spark, sf_dir)
    new = places(spark, sf_dir).select(F.col("place_id").alias("location_id"), F.lit(AS_OF).alias("us"), (-F.col("place_id")).alias("seq"), F.lit("neutral").alias("sentiment"), F.lit(0.5).alias("score"))
    return S.add_entries(entries, new).groupBy("location_id").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


def similar_places(spark, sf_dir):
    """All pairs of similar places with both sentiment profiles."""
    prof = S.location_profile(location_sentiments(spark, sf_dir)).select(F.col("location_id").alias("place_id"), "dominant", "mean")
    known = places(spark, sf_dir).join(prof, "place_id")
    got = P.similar_to(known, known, 0.7, keep=("dominant", "mean")).filter("place_id_a < place_id_b")
    return got.select("place_id_a", "place_id_b", (F.col("dominant_a") == F.col("dominant_b")).alias("same_emotion"), round_up(F.abs(F.col("mean_a") - F.col("mean_b")), 6).alias("difference"))


sig = lambda s, d: S.place_signature(place_visits(s, d))
subject_sig = lambda s, d: S.place_signature(place_visits(s, d), ("subject_id", "place_type"))
trend = lambda s, d: S.trajectories(place_visits(s, d))
QUERIES = {
    "haversine_pairs": lambda s, d: pairs(s, d).select("place_id_a", "place_id_b", *p6("distance_km")),
    "distance_decay": lambda s, d: pairs(s, d).select("place_id_a", "place_id_b", *p6("geographic")),
    "composite_proximity": lambda s, d: scored(s, d).select("place_id_a", "place_id_b", "categorical", "linguistic", *p6("cultural", "proximity")),
    "weight_sensitivity": sensitivity,
    "nearby_places": nearby,
    "near_place_pairs": lambda s, d: P.near_pairs(places(s, d), CLUSTER_M).select("a", "b", F.round("distance_m", 3).alias("distance_m")),
    "geo_clusters": lambda s, d: P.geo_clusters(places(s, d), CLUSTER_M, tables.cut),
    "semantic_dbscan": semantic_dbscan,
    "cluster_silhouette": cluster_quality,
    "cluster_davies_bouldin": cluster_index,
    "notebook_proximity": notebook_pairs,
    "score_time_correlation": pearson,
    "added_entries": added,
    "similar_place_patterns": similar_places,
    "place_signature": lambda s, d: sig(s, d).select("place_type", "visit_count", *r6(*DIM, "volatility")),
    "place_cosine_matrix": lambda s, d: S.cosine_matrix(sig(s, d)).select("place_type_a", "place_type_b", *r6("similarity")),
    "proximate_pairs": lambda s, d: S.proximate_pairs(sig(s, d)).select("place_type_a", "place_type_b", *r6("similarity")),
    "recovery_anchors": lambda s, d: S.recovery_anchors(subject_sig(s, d), threshold=0.4).select("subject_id", "place_type", *r6("anchor_score")),
    "dominant_dimension": lambda s, d: subject_sig(s, d).select("subject_id", "place_type", S.dominant_dimension({k: F.round(k, 9) for k in DIM}).alias("dominant")),
    "place_trajectory": lambda s, d: trend(s, d).select("subject_id", "place_type", "visit_count", *r6(*DIM, "volatility")),
    "recovery_correlations": lambda s, d: S.recovery_correlations(trend(s, d)).select("subject_id", "place_type", "dimension", *r6("slope")),
    "trajectory_summary": lambda s, d: S.trajectory_summary(trend(s, d)).select("subject_id", "place_type", "visit_count", *r6("slope"), "direction"),
    "location_profile": lambda s, d: S.location_profile(location_sentiments(s, d)).select("location_id", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "positive", "neutral", "negative", "dominant"),
    "emotional_hotspots": lambda s, d: S.hotspots(S.location_profile(location_sentiments(s, d))).select("location_id", "dominant", "n", *r6("share")),
    "place_type_comparison": lambda s, d: S.type_comparison(location_sentiments(s, d), types(s, d)).select("type", "n", *r6("mean", "variance", "positive_pct", "neutral_pct", "negative_pct")),
    "place_type_welch_t": lambda s, d: S.welch_t(S.type_comparison(location_sentiments(s, d), types(s, d))).select("type_a", "type_b", *r6("t")),
    "location_trend": lambda s, d: S.location_trend(location_sentiments(s, d)).select("location_id", "n", *r6("slope"), "direction"),
    "anova_by_type": lambda s, d: S.anova_f(location_sentiments(s, d), types(s, d)).select(*r6("f"), "df_between", "df_within"),
    "chi_square_type_sentiment": lambda s, d: S.chi_square(location_sentiments(s, d).join(types(s, d), "location_id"), "type", "sentiment").select(*r6("chi2"), "df"),
}
_hav = P.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
_scores = f"""SELECT a.place_id AS place_id_a, b.place_id AS place_id_b, {_hav} / 1000 AS distance_km, a.type AS ta, b.type AS tb,
  CASE WHEN lower(trim(a.type)) = lower(trim(b.type)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS categorical, CASE WHEN a.language = b.language THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS linguistic,
  len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))) AS cultural FROM places a JOIN places b ON"""
_weighted = "0.3::DOUBLE * exp(-3.0::DOUBLE * distance_km / 500) + 0.4::DOUBLE * categorical + 0.15::DOUBLE * linguistic + 0.15::DOUBLE * cultural"
PAIR_SQL = f"""{PLACES_SQL}, q0 AS ({_scores} a.place_id % 100 = 0 AND a.place_id <> b.place_id),
pairs AS (SELECT *, exp(-3.0::DOUBLE * distance_km / 500) AS geographic, {_weighted} AS proximity FROM q0)"""
ALL_SQL = f"{PLACES_SQL}, q0 AS ({_scores} a.place_id < b.place_id), pairs AS (SELECT *, {_weighted} AS proximity FROM q0)"
_sig = lambda by: f"SELECT {by}, count(*) AS visit_count, " + ", ".join(f'avg("{k}") AS "{k}"' for k in DIM) + f", sqrt(({' + '.join(f'var_pop({chr(34)}{k}{chr(34)})' for k in DIM)}) / 5) AS volatility FROM visits GROUP BY ALL"
_dims6 = ", ".join(f'round("{k}", 6) + 0.0 AS "{k}"' for k in DIM)
_cos = f"({' + '.join(f'a.{k} * b.{k}' for k in DIM)}) / (sqrt({' + '.join(f'a.{k} * a.{k}' for k in DIM)}) * sqrt({' + '.join(f'b.{k} * b.{k}' for k in DIM)}))"
_traj = f"""{VISITS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY subject_id, place_type ORDER BY us, seq) - 1 AS x FROM visits),
tr AS (SELECT subject_id, place_type, count(*) AS visit_count, {', '.join(f'CASE WHEN count(*) > 1 THEN regr_slope("{k}", x) ELSE 0.0 END AS "{k}"' for k in DIM)}, sqrt(({' + '.join(f'var_pop({chr(34)}{k}{chr(34)})' for k in DIM)}) / 5) AS volatility FROM x GROUP BY ALL)"""
_first = lambda exprs: "CASE " + " ".join(f"WHEN {e} = greatest({', '.join(exprs.values())}) THEN {k}" for k, e in exprs.items()) + " END"
_prof = "pf AS (SELECT location_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM ls GROUP BY location_id), prof AS (SELECT *, CASE WHEN positive = greatest(positive, neutral, negative) THEN 'positive' WHEN neutral = greatest(positive, neutral, negative) THEN 'neutral' ELSE 'negative' END AS dominant FROM pf)"
_typed = "tl AS (SELECT ls.*, c_mktsegment AS type FROM ls JOIN customer ON location_id = c_custkey)"
_closure = lambda edges, nodes: f"r AS (SELECT id AS n, id AS m FROM ({nodes}) UNION SELECT e.y, r.m FROM r JOIN ({edges}) e ON e.x = r.n)"
_near = f"np AS (SELECT a.place_id AS a, b.place_id AS b, {_hav} AS distance_m FROM places a JOIN places b ON a.place_id < b.place_id AND {_hav} <= {CLUSTER_M})"
_db = "nb AS (SELECT place_id_a AS a, place_id_b AS b FROM pairs WHERE proximity >= 0.68), bt AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb), core AS (SELECT DISTINCT a AS id FROM bt)"
_dbr = f"{_closure('SELECT a AS x, b AS y FROM bt', 'SELECT id FROM core')}, cl AS (SELECT n AS place_id, min(m) AS cluster_id FROM r GROUP BY n), db AS (SELECT place_id, coalesce(cluster_id, -1) AS cluster_id FROM places LEFT JOIN cl USING (place_id))"
ORACLES = {
    "notebook_proximity": f"WITH {PLACES_SQL}, k AS (SELECT a.place_id AS place_id_a, b.place_id AS place_id_b, 2 * 6371::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS d FROM places a JOIN places b ON a.place_id % 100 = 0 AND a.place_id <> b.place_id) SELECT place_id_a, place_id_b, round(d, 6) AS km, round(greatest(0.0, 1 - d / 2000), 6) AS linear FROM k",
    "score_time_correlation": f"WITH {LOCATIONS_SQL} SELECT count(*) AS n, round(corr(score, us / 86400000000::DOUBLE), 6) AS r FROM ls",
    "added_entries": f"WITH {LOCATIONS_SQL} SELECT c_custkey AS location_id, 1 + count(us) AS n, greatest(coalesce(max(us), 0), 1706000000000000) AS last_us FROM customer LEFT JOIN ls ON location_id = c_custkey GROUP BY c_custkey",
    "haversine_pairs": f"WITH {PAIR_SQL} SELECT place_id_a, place_id_b, round(distance_km, 6) AS distance_km FROM pairs",
    "distance_decay": f"WITH {PAIR_SQL} SELECT place_id_a, place_id_b, round(geographic, 6) AS geographic FROM pairs",
    "composite_proximity": f"WITH {PAIR_SQL} SELECT place_id_a, place_id_b, categorical, linguistic, round(cultural, 6) AS cultural, round(proximity, 6) AS proximity FROM pairs",
    "weight_sensitivity": f"WITH {PAIR_SQL} " + " UNION ALL ".join(f"SELECT ta = tb AS same_type, '{k}' AS scenario, round(avg({w[0]}::DOUBLE * geographic + {w[1]}::DOUBLE * categorical + {w[2]}::DOUBLE * linguistic + {w[3]}::DOUBLE * cultural), 6) AS mean_proximity FROM pairs GROUP BY ta = tb" for k, w in SCENARIOS.items()),
    "nearby_places": f"WITH {PLACES_SQL} SELECT a.place_id AS target_id, b.place_id AS place_id, round({_hav}, 3) AS distance_m FROM places a, places b WHERE a.place_id % 100 = 0 AND NOT (a.lat = b.lat AND a.lon = b.lon) AND {_hav} <= {METRES}",
    "near_place_pairs": f"WITH {PLACES_SQL}, {_near} SELECT a, b, round(distance_m, 3) AS distance_m FROM np",
    "geo_clusters": f"WITH RECURSIVE {PLACES_SQL}, {_near}, {_closure('SELECT a AS x, b AS y FROM np UNION ALL SELECT b, a FROM np', 'SELECT place_id AS id FROM places')} SELECT n AS place_id, min(m) AS cluster_id FROM r GROUP BY n",
    "place_signature": f"WITH {VISITS_SQL}, sg AS ({_sig('place_type')}) SELECT place_type, visit_count, {_dims6}, round(volatility, 6) AS volatility FROM sg",
    "place_cosine_matrix": f"WITH {VISITS_SQL}, sg AS ({_sig('place_type')}) SELECT a.place_type AS place_type_a, b.place_type AS place_type_b, round(CASE WHEN a.place_type = b.place_type THEN 1.0 ELSE {_cos} END, 6) AS similarity FROM sg a, sg b",
    "proximate_pairs": f"WITH {VISITS_SQL}, sg AS ({_sig('place_type')}) SELECT a.place_type AS place_type_a, b.place_type AS place_type_b, round({_cos}, 6) AS similarity FROM sg a JOIN sg b ON a.place_type < b.place_type WHERE {_cos} >= 0.7",
    "recovery_anchors": f'WITH {VISITS_SQL}, sg AS ({_sig("subject_id, place_type")}), z AS (SELECT *, greatest("Hope", "Connectedness") * greatest(0.0, 1 - volatility) AS s FROM sg WHERE visit_count >= 2) SELECT subject_id, place_type, round(s, 6) AS anchor_score FROM z WHERE s >= 0.4',
    "dominant_dimension": f"WITH {VISITS_SQL}, sg AS ({_sig('subject_id, place_type')}) SELECT subject_id, place_type, " + _first({f"'{k}'": f'round("{k}", 9)' for k in DIM}) + " AS dominant FROM sg",
    "place_trajectory": f"WITH {_traj} SELECT subject_id, place_type, visit_count, {_dims6}, round(volatility, 6) AS volatility FROM tr",
    "recovery_correlations": f"WITH {_traj}, u AS (" + " UNION ALL ".join(f"SELECT subject_id, place_type, visit_count, '{k}' AS dimension, \"{k}\" AS slope FROM tr" for k in DIM) + ") SELECT subject_id, place_type, dimension, round(slope, 6) AS slope FROM u WHERE visit_count >= 2 AND slope > 0.01",
    "trajectory_summary": f"WITH {_traj}, z AS (SELECT *, " + _first({f'"{k}"': f'abs("{k}")' for k in DIM}) + " AS slope FROM tr) SELECT subject_id, place_type, visit_count, round(slope, 6) AS slope, CASE WHEN slope > 0.01 THEN 'improving' WHEN slope < -0.01 THEN 'declining' ELSE 'stable' END AS direction FROM z",
    "location_profile": f"WITH {LOCATIONS_SQL}, {_prof} SELECT location_id, n, round(mean, 9) AS mean, round(std, 9) AS std, positive, neutral, negative, dominant FROM prof",
    "emotional_hotspots": f"WITH {LOCATIONS_SQL}, {_prof} SELECT location_id, dominant, n, round(greatest(positive, neutral, negative) / n, 6) AS share FROM prof WHERE n >= 3 AND greatest(positive, neutral, negative) / n >= 0.6",
    "place_type_comparison": f"WITH {LOCATIONS_SQL}, {_typed} SELECT type, count(*) AS n, round(avg(score), 6) AS mean, round(var_samp(score), 6) AS variance, " + ", ".join(f"round(count(*) FILTER (WHERE sentiment = '{k}') * 100 / count(*), 6) AS {k}_pct" for k in ("positive", "neutral", "negative")) + " FROM tl GROUP BY type",
    "place_type_welch_t": f"WITH {LOCATIONS_SQL}, {_typed}, g AS (SELECT type, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM tl GROUP BY type) SELECT a.type AS type_a, b.type AS type_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t FROM g a JOIN g b ON a.type < b.type",
    "location_trend": f"""WITH {LOCATIONS_SQL}, x AS (SELECT *, (us - min(us) OVER (PARTITION BY location_id)) / {S.MONTH_US}::DOUBLE AS t FROM ls), y AS (SELECT location_id, count(*) AS n, CASE WHEN var_pop(t) > 0 THEN regr_slope(score, t) ELSE 0.0 END AS slope FROM x GROUP BY location_id)
SELECT location_id, n, round(slope, 6) AS slope, CASE WHEN slope >= 0.1 THEN 'improving' WHEN slope <= -0.1 THEN 'declining' ELSE 'stable' END AS direction FROM y""",
    "anova_by_type": f"WITH {LOCATIONS_SQL}, {_typed}, g AS (SELECT type, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM tl GROUP BY type), z AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS gm, sum(n * v) AS w, sum(n * m * m) AS raw FROM g) SELECT round((raw - n * gm * gm) / (k - 1) / (w / (n - k)), 6) AS f, k - 1 AS df_between, n - k AS df_within FROM z",
    "chi_square_type_sentiment": f"""WITH {LOCATIONS_SQL}, {_typed}, c AS (SELECT type, sentiment, count(*) AS o FROM tl GROUP BY ALL), e AS (SELECT a.type, b.sentiment, ra * rb / (SELECT sum(o) FROM c) AS e FROM (SELECT type, sum(o) AS ra FROM c GROUP BY type) a, (SELECT sentiment, sum(o) AS rb FROM c GROUP BY sentiment) b)
SELECT round(sum(pow(coalesce(o, 0) - e, 2) / e), 6) AS chi2, (count(DISTINCT e.type) - 1) * (count(DISTINCT e.sentiment) - 1) AS df FROM e LEFT JOIN c USING (type, sentiment)""",
    "semantic_dbscan": f"WITH RECURSIVE {ALL_SQL}, {_db}, {_dbr} SELECT place_id, cluster_id FROM db",
    "cluster_silhouette": f"""WITH RECURSIVE {ALL_SQL}, {_db}, {_dbr}, k AS (SELECT * FROM db WHERE cluster_id <> -1), d AS (SELECT a.place_id AS a, a.cluster_id AS ca, b.cluster_id AS cb, avg(1 - proximity) AS d
  FROM pairs JOIN k a ON a.place_id IN (place_id_a, place_id_b) AND a.place_id % 100 = 0 JOIN k b ON b.place_id IN (place_id_a, place_id_b) AND b.place_id <> a.place_id GROUP BY ALL),
p AS (SELECT a, ca, min(d) FILTER (WHERE ca = cb) AS own, min(d) FILTER (WHERE ca <> cb) AS other FROM d GROUP BY ALL)
SELECT ca AS cluster_id, count(*) AS n, round(avg(CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) = 0 THEN 0.0::DOUBLE ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM p GROUP BY ca""",
    "similar_place_patterns": f"WITH {ALL_SQL}, {LOCATIONS_SQL}, {_prof} SELECT place_id_a, place_id_b, a.dominant = b.dominant AS same_emotion, round(abs(a.mean - b.mean), 6) AS difference FROM pairs JOIN prof a ON a.location_id = place_id_a JOIN prof b ON b.location_id = place_id_b WHERE proximity >= 0.7",
}
