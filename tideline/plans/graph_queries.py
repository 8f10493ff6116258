"""Queries over the episode graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import iso_sql
from tideline.operators import graphs, segments
from tideline.plans.timelines import EPISODES_SQL, GAP, HOUR, episodes
from tideline.sources.adapters import CHIME, EVENTS_SQL, emotion_events
from tideline.sources.tables import cut

NEAR = 12 * HOUR


def graph(spark, sf_dir):
    """Episodes, made once and written, and their edges: made anew for every side of a join by subject, all of their sorts
    would be held by one task."""
    made = cut(episodes(spark, sf_dir))
    return made, graphs.narrative_edges(made, NEAR)


def edges(spark, sf_dir):
    return graph(spark, sf_dir)[1]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def all_pairs(spark, sf_dir):
    got = graphs.classified(graphs.episode_pairs(cut(episodes(spark, sf_dir)), None), NEAR)
    return got.select("subject_id", "episode_index_a", "episode_index_b", "relation", "gap_us", *r6("overlap_coefficient", "weight"))


def touching(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.filter("source_index = 0 OR target_index = 0").select("subject_id", "source_index", "target_index", "relation")


def transitions(spark, sf_dir):
    got = graphs.common_transitions(edges(spark, sf_dir), None)
    return got.groupBy("source_label", "target_label").agg(F.sum("n").cast("long").alias("n"))


def blended(spark, sf_dir):
    ep, lines = graph(spark, sf_dir)
    sig = ep.filter("event_count > 1").select("subject_id", "episode_index", *((F.pmod(F.col("start_us") / 1_000_000 * m, F.lit(101)).cast("long") / 100.0).alias(k) for k, m in CHIME.items()))
    return graphs.blended_edges(lines, sig, list(CHIME)).select("subject_id", "source_index", "target_index", "relation", *r6("weight"))


def report(spark, sf_dir):
    got = graphs.graph_report(*graph(spark, sf_dir), NEAR)
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("transitions", "cycles", "labels")]
    return got.select("subject_id", "node_count", "edge_count", *r6("density"), "component_count", "is_dag", *sizes)


def sessions(spark, sf_dir):
    """Events with their episode, every seventh of them a day late."""
    got = segments.gap_sessions(emotion_events(spark, sf_dir), GAP)
    return got.withColumn("us", F.col("us") + F.when(F.pmod("seq", F.lit(7)) == 0, 24 * HOUR).otherwise(0))


def percentages(spark, sf_dir):
    """Estimates of events whose id isn't divisible by three."""
    e = segments.gap_sessions(emotion_events(spark, sf_dir), GAP)
    share = lambda m: F.when(F.pmod("seq", F.lit(3)) != 0, F.pmod("seq", F.lit(m)) / m)
    return segments.episode_percentages(episodes(spark, sf_dir), e.select("subject_id", "episode_index", share(5).alias("positive"), share(7).alias("neutral"), share(11).alias("negative")))


QUERIES = {
    "graph_report": report,
    "node_metrics": lambda s, d: graphs.node_metrics(*graph(s, d)).select("subject_id", "episode_index", "start_time", "end_time", "dominant_label", *r6("degree", "in_degree", "out_degree", "betweenness")),
    "frontend_nodes": lambda s, d: graphs.frontend_nodes(episodes(s, d)),
    "episode_violations": lambda s, d: segments.episode_violations(episodes(s, d), sessions(s, d)),
    "episode_percentages": percentages,
    "narrative_edges": lambda s, d: edges(s, d).select("subject_id", "source_index", "target_index", "relation", *r6("weight")),
    "narrative_edges_all_pairs": all_pairs,
    "edges_for_node": touching,
    "graph_ids": lambda s, d: graphs.graph_ids(*graph(s, d)),
    "frontend_edges": lambda s, d: graphs.frontend_edges(*graph(s, d)),
    "graph_summary": lambda s, d: graphs.graph_summary(*graph(s, d), NEAR).select("subject_id", "node_count", "edge_count", *r6("density"), "component_count", "is_dag"),
    "degree_centrality": lambda s, d: graphs.degree_centrality(*graph(s, d)).select("subject_id", "episode_index", *r6("degree", "in_degree", "out_degree")),
    "common_transitions": transitions,
    "subject_transitions": lambda s, d: graphs.common_transitions(edges(s, d)),
    "label_distribution": lambda s, d: graphs.label_distribution(episodes(s, d)),
    "emotional_cycles": lambda s, d: graphs.label_cycles(edges(s, d)),
    "betweenness_weighted": lambda s, d: graphs.betweenness(*graph(s, d)).select("subject_id", "episode_index", *r6("betweenness")),
    "betweenness_hop": lambda s, d: graphs.betweenness(*graph(s, d), "hop").select("subject_id", "episode_index", *r6("betweenness")),
    "place_blended_edges": blended,
}
PAIRS_SQL = f"""p0 AS (SELECT a.subject_id, a.episode_index AS i, b.episode_index AS j, a.start_us AS a0, a.end_us AS a1, b.start_us AS b0, b.end_us AS b1, a.dominant_label AS sl, b.dominant_label AS tl, a.episode_id AS sid, b.episode_id AS tid
  FROM episodes a JOIN episodes b ON a.subject_id = b.subject_id AND a.episode_index < b.episode_index),
p1 AS (SELECT *, CASE WHEN least(a1, b1) > greatest(a0, b0) THEN (least(a1, b1) - greatest(a0, b0)) / least(a1 - a0, b1 - b0) ELSE 0.0 END AS overlap, greatest(0, b0 - a1, a0 - b1) AS gap FROM p0),
p2 AS (SELECT *, CASE WHEN overlap > 0 THEN 'overlapping' WHEN gap <= {NEAR} THEN 'adjacent' ELSE 'disjoint' END AS relation FROM p1),
pairs AS (SELECT *, CASE relation WHEN 'overlapping' THEN 1.0::DOUBLE WHEN 'adjacent' THEN greatest(0.0::DOUBLE, 1 - gap / {NEAR}::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM p2),
edges AS (SELECT * FROM pairs WHERE relation <> 'disjoint')"""
BASE = f"WITH {EVENTS_SQL}, {EPISODES_SQL}, {PAIRS_SQL}"
STEPS = "st AS (SELECT DISTINCT subject_id, sl AS a, tl AS b FROM edges)"
_dot = " + ".join(f'a."{k}" * b."{k}"' for k in CHIME)
_na, _nb = (" + ".join(f'{x}."{k}" * {x}."{k}"' for k in CHIME) for x in "ab")
ORACLES = {
    "frontend_nodes": f"{BASE} SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY start_us, episode_index) - 1 AS node, episode_id, {iso_sql('start_us')} AS start_time, {iso_sql('end_us')} AS end_time, coalesce(dominant_label, 'unknown') AS label, event_count, round((end_us - start_us) / 3600000000::DOUBLE, 4) AS hours FROM episodes",
    "episode_percentages": f"{BASE} SELECT subject_id, episode_index, " + ", ".join(f"CAST(coalesce(floor(avg(CASE WHEN seq % 3 <> 0 THEN seq % {m} / {m}::DOUBLE END) * 100 + 0.5), 0) AS BIGINT) AS {k}" for k, m in (("positive", 5), ("neutral", 7), ("negative", 11))) + " FROM s2 GROUP BY ALL",
    "episode_violations": f"""{BASE}, x AS (SELECT subject_id, episode_index, seq, us + CASE WHEN seq % 7 = 0 THEN 86400000000 ELSE 0 END AS us FROM s2), y AS (SELECT x.*, lag(us) OVER (PARTITION BY subject_id, episode_index ORDER BY seq) AS b FROM x), z AS (SELECT y.*, start_us, end_us FROM y JOIN episodes USING (subject_id, episode_index))
SELECT subject_id, episode_index, 'event before start' AS problem, count(*) AS n FROM z WHERE us < start_us GROUP BY ALL UNION ALL SELECT subject_id, episode_index, 'event at or after end', count(*) FROM z WHERE us >= end_us GROUP BY ALL UNION ALL SELECT subject_id, episode_index, 'events out of order', count(*) FROM z WHERE us < b GROUP BY ALL""",
    "graph_report": f"""{BASE}, br AS (SELECT subject_id, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY subject_id ORDER BY episode_index) > {NEAR} THEN 1 ELSE 0 END AS b FROM episodes), n AS (SELECT subject_id, count(DISTINCT dominant_label) AS n_labels FROM episodes GROUP BY subject_id),
m AS (SELECT subject_id, count(*) AS m, count(DISTINCT sl || '>' || tl) AS t FROM edges GROUP BY subject_id), {STEPS}, cy AS (SELECT subject_id, a AS cycle FROM st WHERE a = b UNION SELECT x.subject_id, x.a || '>' || x.b FROM st x JOIN st y ON x.subject_id = y.subject_id AND x.b = y.a AND y.b = x.a WHERE x.a < x.b
UNION SELECT x.subject_id, x.a || '>' || x.b || '>' || y.b FROM st x JOIN st y ON x.subject_id = y.subject_id AND x.b = y.a JOIN st z ON z.subject_id = y.subject_id AND y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b), cn AS (SELECT subject_id, count(*) AS c FROM cy GROUP BY subject_id),
k AS (SELECT subject_id, count(*) AS node_count FROM episodes GROUP BY subject_id), c2 AS (SELECT subject_id, CAST(sum(b) + 1 AS BIGINT) AS component_count FROM br GROUP BY subject_id)
SELECT subject_id, k.node_count, coalesce(m, 0) AS edge_count, round(CASE WHEN k.node_count <= 1 THEN 0.0 ELSE coalesce(m, 0) / (k.node_count * (k.node_count - 1)) END, 6) AS density, c2.component_count, true AS is_dag, least(coalesce(t, 0), 10) AS n_transitions, coalesce(c, 0) AS n_cycles, n_labels FROM k JOIN c2 USING (subject_id) JOIN n USING (subject_id) LEFT JOIN m USING (subject_id) LEFT JOIN cn USING (subject_id)""",
    "narrative_edges": f"{BASE} SELECT subject_id, i AS source_index, j AS target_index, relation, round(weight, 6) AS weight FROM edges",
    "narrative_edges_all_pairs": f"{BASE} SELECT subject_id, i AS episode_index_a, j AS episode_index_b, relation, gap AS gap_us, round(overlap, 6) AS overlap_coefficient, round(weight, 6) AS weight FROM pairs",
    "edges_for_node": f"{BASE} SELECT subject_id, i AS source_index, j AS target_index, relation FROM edges WHERE i = 0 OR j = 0",
    "graph_ids": f"""{BASE}, n AS (SELECT subject_id, string_agg(':' || episode_id, '' ORDER BY episode_index) AS t FROM episodes GROUP BY subject_id), l AS (SELECT subject_id, string_agg(':' || i || ':' || j || ':' || relation, '' ORDER BY i, j) AS t FROM edges GROUP BY subject_id)
SELECT n.subject_id, left(sha256(n.t || coalesce(l.t, '')), 32) AS graph_id FROM n LEFT JOIN l USING (subject_id)""",
    "frontend_edges": f"{BASE} SELECT subject_id, i AS source, j AS target, relation, left(sha256(sid || ':' || tid), 32) AS edge_id FROM edges",
    "graph_summary": f"""{BASE}, br AS (SELECT subject_id, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY subject_id ORDER BY episode_index) > {NEAR} THEN 1 ELSE 0 END AS b FROM episodes),
n AS (SELECT subject_id, count(*) AS node_count, CAST(sum(b) + 1 AS BIGINT) AS component_count FROM br GROUP BY subject_id), m AS (SELECT subject_id, count(*) AS m FROM edges GROUP BY subject_id)
SELECT subject_id, node_count, coalesce(m, 0) AS edge_count, round(CASE WHEN node_count <= 1 THEN 0.0 ELSE coalesce(m, 0) / (node_count * (node_count - 1)) END, 6) AS density, component_count, true AS is_dag FROM n LEFT JOIN m USING (subject_id)""",
    "degree_centrality": f"""{BASE}, d AS (SELECT subject_id, k, sum(o) AS o, sum(x) AS x FROM (SELECT subject_id, i AS k, 1 AS o, 0 AS x FROM edges UNION ALL SELECT subject_id, j, 0, 1 FROM edges) GROUP BY ALL), n AS (SELECT subject_id, episode_index, count(*) OVER (PARTITION BY subject_id) AS n FROM episodes)
SELECT n.subject_id, episode_index, {', '.join(f"round(CASE WHEN n = 1 THEN 1.0 ELSE coalesce({e}, 0) / (n - 1) END, 6) AS {a}" for e, a in (('o + x', 'degree'), ('x', 'in_degree'), ('o', 'out_degree')))} FROM n LEFT JOIN d ON d.subject_id = n.subject_id AND k = episode_index""",
    "common_transitions": f"{BASE} SELECT sl AS source_label, tl AS target_label, count(*) AS n FROM edges GROUP BY ALL",
    "subject_transitions": f"""{BASE}, t AS (SELECT subject_id, sl AS source_label, tl AS target_label, count(*) AS n, min(i * 1000000000 + j) AS f FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, f) AS rank FROM t) SELECT subject_id, source_label, target_label, n, rank FROM r WHERE rank <= 10""",
    "label_distribution": f"{BASE} SELECT subject_id, dominant_label, count(*) AS n FROM episodes GROUP BY ALL",
    "emotional_cycles": f"""{BASE}, {STEPS} SELECT subject_id, a AS cycle, 1::BIGINT AS length FROM st WHERE a = b
UNION ALL SELECT x.subject_id, x.a || '>' || x.b, 2 FROM st x JOIN st y ON x.subject_id = y.subject_id AND x.b = y.a AND y.b = x.a WHERE x.a < x.b
UNION ALL SELECT x.subject_id, x.a || '>' || x.b || '>' || y.b, 3 FROM st x JOIN st y ON x.subject_id = y.subject_id AND x.b = y.a JOIN st z ON z.subject_id = y.subject_id AND y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b""",
    "place_blended_edges": f"""{BASE}, sig AS (SELECT subject_id, episode_index, {', '.join(f'CAST(floor(fmod(start_us / 1000000 * {m}, 101)) AS BIGINT) / 100.0::DOUBLE AS "{k}"' for k, m in CHIME.items())} FROM episodes WHERE event_count > 1)
SELECT e.subject_id, i AS source_index, j AS target_index, relation, round(CASE WHEN a.subject_id IS NOT NULL AND b.subject_id IS NOT NULL THEN least(1.0, greatest(0.0, 0.7::DOUBLE * weight + 0.3::DOUBLE * CASE WHEN ({_na}) = 0 OR ({_nb}) = 0 THEN 0.0 ELSE ({_dot}) / (sqrt({_na}) * sqrt({_nb})) END)) ELSE weight END, 6) AS weight
FROM edges e LEFT JOIN sig a ON a.subject_id = e.subject_id AND a.episode_index = i LEFT JOIN sig b ON b.subject_id = e.subject_id AND b.episode_index = j""",
}
