"""Queries over records of posts, corrections, runs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import models, text as T
from tideline.functions.scalars import iso, round_up
from tideline.operators import corrections, evaluation as E, frames as FR, graphs, integrity as I, keywords as K, places as P, signatures as S, timeline
from tideline.plans.graph_queries import ORACLES as GRAPHS, edges
from tideline.plans.place_queries import ORACLES as PLACES, PLACES_SQL
from tideline.sources import store
from tideline.sources.adapters import EVENTS_SQL, emotion_events, place_visits, places, table

POLICIES = tuple(timeline.MISSING_SCORE)


def posts(spark, sf_dir):
    """Events as posts with times as text; every fourth has no label, every third no score, every ninth no time."""
    e = emotion_events(spark, sf_dir)
    n = F.col("seq")
    when = F.when(n % 9 == 0, F.lit("soon")).otherwise(F.concat(iso(F.col("us")), F.when(n % 2 == 0, "Z").otherwise("")))
    return e.select(F.col("subject_id").alias("user_id"), n.alias("post_id"), when.alias("timestamp"), F.when(n % 4 != 0, F.col("label")).alias("label"), F.when(n % 3 != 0, F.col("score")).alias("score"))


def outputs(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    n = F.col("seq")
    part = lambda k: F.when(n % k != 0, (n % k) / 10.0)
    rows = e.select("subject_id", "seq", F.when(n % 5 != 0, iso(F.col("us"))).alias("timestamp"), part(3).alias("positive"), part(4).alias("neutral"), part(5).alias("negative"), part(2).alias("uncertainty"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("i"), n.cast("string"))).alias("image_id"), F.lit("s").alias("source_id"))
    return FR.from_outputs(rows, 1_700_000_000_000_000)


def refused(spark, sf_dir):
    """Corrections by event: some lack a label or give one that there isn't, and users by name."""
    e = emotion_events(spark, sf_dir)
    n = F.col("seq")
    label = F.when(n % 5 == 0, "").when(n % 5 == 1, "hope").otherwise(F.element_at(F.array(*map(F.lit, I.CORRECTIONS)), (n % 6 + 1).cast("int")))
    user = F.when(n % 7 == 0, F.lit("a b")).when(n % 7 == 1, F.lit("x" * 65)).otherwise(F.concat(F.lit("ü.-@"), F.col("subject_id").cast("string")))
    return e.select("seq", I.correction_problem(n, label).alias("problem"), I.user_id_ok(user).alias("user_ok"))


def waiting(spark, sf_dir):
    n = F.col("seq")
    return corrections.pending(emotion_events(spark, sf_dir).select(F.when(n % 3 != 0, F.col("label")).alias("label"), F.when(n % 2 == 0, "pending").otherwise("done").alias("status")))


def stability(spark, sf_dir):
    """Order totals as runs: the spread of a metric over seeds."""
    return E.stability(table(spark, sf_dir, "orders").select((F.col("o_totalprice") % 97 / 97).alias("macro_f1"), (F.col("o_orderkey") % 11 / 11).alias("accuracy")), ["macro_f1", "accuracy"]).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def compared(spark, sf_dir):
    """Estimates of neighbouring vectors as pictures."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(F.abs(F.col("embedding")[i].cast("double")), 6).alias(c) for i, c in enumerate(FR.CLASSES)))
    a, b = e.select(F.col("vec_id"), F.struct(*FR.CLASSES).alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.struct(*FR.CLASSES).alias("b"))
    return a.join(b, "vec_id").select("vec_id", FR.compare_estimates("a", "b").alias("d")).select("vec_id", *(F.round(F.col(f"d.{c}"), 6).alias(c) for c in FR.CLASSES), F.col("d.different").alias("different"))


def results(spark, sf_dir):
    """The best of three scores of a vector, with a missing one and equal ones; none for every fifth."""
    n = F.col("vec_id")
    entry = lambda name, score: F.struct(F.lit(name).alias("label"), score.cast("double").alias("score"))
    found = F.array(entry("a", n % 3), entry("b", F.when(n % 2 == 0, n % 4)), entry("c", n % 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", T.top_result(F.when(n % 5 != 0, found)).alias("t")).select("vec_id", "t.label", "t.score")


def notebook(spark, sf_dir):
    """The notebook's parts of the places whose id is divisible by 100 against all."""
    pairs = P.place_pairs(places(spark, sf_dir).filter("place_id % 100 = 0"), places(spark, sf_dir).withColumn("type", F.when(F.col("place_id") % 3 == 0, F.col("type")).otherwise("garden")), P.notebook_attributes)
    near = round_up(P.linear_near(F.col("haversine"), 2000.0), 6).alias("geographic")
    return pairs.select("place_id_a", "place_id_b", near, "categorical", "linguistic", round_up(F.col("cultural"), 6).alias("cultural"))


def concepts(spark, sf_dir):
    c = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return c.select("p_partkey", F.array_join(K.main_concepts(F.array(F.lit("The Old House"), F.concat(F.lit("Room "), (k % 3).cast("string"))), F.when(k % 2 == 0, F.array(F.lit("house"), F.lit("old house"), F.lit("my"), F.lit("ox")))), "|").alias("concepts"))


def vectors(spark, sf_dir):
    """Vectors by document, of which two batches replace some; the last one of a key counts."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("captions").alias("collection"), F.col("vec_id").alias("doc_id"), F.lit(0).alias("version"))
    new = e.filter("doc_id % 3 = 0").select("collection", "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).withColumn("at", F.col("version"))
    return store.upsert_vectors(e, new, "at")


def located(spark, sf_dir):
    """Customers' places by a gazetteer of every second one, and the words for them."""
    known = places(spark, sf_dir).filter("place_id % 2 = 0").select("lat", "lon", F.lit("shop").alias("category"), F.lower(F.trim("type")).alias("kind"), F.concat(F.lit("No "), F.col("place_id").cast("string"), F.lit(", town")).alias("name"))
    return models.enrich_locations(places(spark, sf_dir).select("place_id", "lat", "lon"), known)


def processed(spark, sf_dir):
    """Customers' remarks as posts: their sentiment and time."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("post_id"), F.when(k % 3 == 0, "a happy smile").when(k % 3 == 1, "so sad and angry").otherwise(" ").alias("caption"), F.when(k % 5 == 0, "2024-01-02T03:04:05+02:00").otherwise("2024-01-02T03:04:05").alias("timestamp"))
    got = models.enrich_posts(rows, ("sentiment", "embedding"))
    return got.select("post_id", F.col("sentiment.label").alias("label"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("embedding").isNotNull().alias("has_vector"))


def ranked(spark, sf_dir):
    """Pairs of place types, the likeliest first."""
    pairs = S.proximate_pairs(S.place_signature(place_visits(spark, sf_dir)))
    return pairs.select("place_type_a", "place_type_b", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "place_type_a", "place_type_b")


def leveled(spark, sf_dir):
    """Scores by the first text-like column that a table has."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.length(T.first_existing(c.columns, T.TEXT_NAMES)).cast("long").alias("chars"))


QUERIES = {
    **{f"timeline_of_posts_{p}": (lambda p: lambda s, d: timeline.of_posts(posts(s, d), p))(p) for p in POLICIES},
    "edges_by_relation": lambda s, d: graphs.edges_by_relation(edges(s, d), "adjacent").select("subject_id", "source_index", "target_index"),
    "frames_of_outputs": outputs,
    "refused_corrections": refused,
    "pending_corrections": waiting,
    "seed_stability": stability,
    "compared_estimates": compared,
    "top_results": results,
    "notebook_parts": notebook,
    "main_concepts": concepts,
    "vector_upserts": vectors,
    "located_places": lambda s, d: located(s, d).select("place_id", "location_text"),
    "processed_posts": processed,
    "ranked_pairs": ranked,
    "text_lengths": leveled,
}
_labels = "[" + ", ".join(f"'{x}'" for x in I.CORRECTIONS) + "]"
_posts = "SELECT subject_id, us, seq, CASE WHEN seq % 4 <> 0 THEN label ELSE 'neutral' END AS label, CASE WHEN seq % 3 <> 0 THEN score {} END AS score FROM ev WHERE seq % 9 <> 0"
_part = lambda k, default: f"CASE WHEN seq % {k} <> 0 THEN seq % {k} / 10.0::DOUBLE ELSE {default}::DOUBLE END"
ORACLES = {
    "timeline_of_posts_shown": f"WITH {EVENTS_SQL} {_posts.format('ELSE 0.0')}",
    "timeline_of_posts_stored": f"WITH {EVENTS_SQL} {_posts.format('')}",
    "edges_by_relation": f"WITH ed AS ({GRAPHS['narrative_edges']}) SELECT subject_id, source_index, target_index FROM ed WHERE relation = 'adjacent'",
    "frames_of_outputs": f"""WITH {EVENTS_SQL} SELECT subject_id, CASE WHEN seq % 5 <> 0 THEN us ELSE 1700000000000000 + seq * 100000 END AS us, seq, {_part(3, '0.0')} AS positive, {_part(4, '1.0')} AS neutral, {_part(5, '0.0')} AS negative, {_part(2, '0.1')} AS uncertainty,
  CASE WHEN seq % 3 = 0 THEN 's' ELSE 'i' || seq END AS source_id FROM ev""",
    "refused_corrections": f"WITH {EVENTS_SQL} SELECT seq, CASE seq % 5 WHEN 0 THEN 'Missing data' WHEN 1 THEN 'Invalid label' END AS problem, seq % 7 > 1 AS user_ok FROM ev",
    "pending_corrections": f"WITH {EVENTS_SQL} SELECT count(*) FILTER (WHERE seq % 3 <> 0 AND label IS NOT NULL AND seq % 2 = 0) AS waiting FROM ev",
    "seed_stability": "WITH r AS (SELECT 'macro_f1' AS metric, o_totalprice % 97 / 97 AS v FROM orders UNION ALL SELECT 'accuracy', o_orderkey % 11 / 11.0::DOUBLE FROM orders) SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM r GROUP BY metric",
    "compared_estimates": "WITH e AS (SELECT vec_id, round(abs(embedding[1]::DOUBLE), 6) AS p, round(abs(embedding[2]::DOUBLE), 6) AS n, round(abs(embedding[3]::DOUBLE), 6) AS g FROM embeddings) SELECT a.vec_id, round(abs(a.p - b.p), 6) AS positive, round(abs(a.n - b.n), 6) AS neutral, round(abs(a.g - b.g), 6) AS negative, greatest(abs(a.p - b.p), abs(a.n - b.n), abs(a.g - b.g)) > 0.01 AS different FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "top_results": "WITH s AS (SELECT vec_id, vec_id % 3 AS a, CASE WHEN vec_id % 2 = 0 THEN vec_id % 4 ELSE 0 END AS b FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'Uncategorized' WHEN b > a THEN 'b' ELSE 'a' END AS label, CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(a, b)::DOUBLE END AS score FROM s",
    "notebook_parts": f"""WITH {PLACES_SQL}, k AS (SELECT a.place_id AS place_id_a, b.place_id AS place_id_b, 2 * 6371::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS d,
  CASE WHEN a.type = b.type AND b.place_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS categorical, CASE WHEN a.language = b.language THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS linguistic, round(len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS cultural
  FROM places a JOIN places b ON a.place_id % 100 = 0 AND a.place_id <> b.place_id) SELECT place_id_a, place_id_b, round(greatest(0.0::DOUBLE, 1 - d / 2000), 6) AS geographic, categorical, linguistic, cultural FROM k""",
    "main_concepts": "SELECT p_partkey, 'room ' || p_partkey % 3 || '|the old house' AS concepts FROM part",
    "vector_upserts": "SELECT 'captions' AS collection, vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 0 END AS version FROM embeddings",
    "located_places": f"WITH {PLACES_SQL} SELECT place_id, CASE WHEN place_id % 2 = 0 THEN 'shop ' || lower(trim(type)) || ' No ' || place_id ELSE 'unknown location at coordinates ' || lat || ' ' || lon END AS location_text FROM places",
    "processed_posts": "SELECT o_orderkey AS post_id, ['positive', 'negative', 'neutral'][o_orderkey % 3 + 1] AS label, CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-02 01:04:05' ELSE '2024-01-02 03:04:05' END AS at, o_orderkey % 3 < 2 AS has_vector FROM orders",
    "ranked_pairs": PLACES["proximate_pairs"],
    "text_lengths": "SELECT conv_id, turn, length(text) AS chars FROM conversations",
}
