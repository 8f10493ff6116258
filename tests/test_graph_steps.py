"""Graph queries make episodes once, and their numbers equal plain counts."""

from collections import Counter

import pytest

from tideline.operators import graphs
from tideline.plans.graph_queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["node_metrics", "degree_centrality", "graph_summary", "frontend_edges", "betweenness_hop", "narrative_edges_all_pairs", "place_blended_edges"])
def test_events_are_sorted_into_episodes_once(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("lag(us") <= 1


def test_degrees_take_both_ends_of_an_edge_at_once(spark):
    episodes = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "subject_id long, episode_index long")
    lines = [(1, 0, 1), (1, 0, 2), (1, 0, 2), (1, 1, 1), (1, 0, 9)]  # a double edge, a loop, an end that isn't a node
    df = graphs.degree_centrality(episodes, spark.createDataFrame(lines, "subject_id long, source_index long, target_index long"))
    assert "Union" not in plan_of(df)
    out, into = Counter((s, a) for s, a, _ in lines), Counter((s, b) for s, _, b in lines)
    got = {(r["subject_id"], r["episode_index"]): (r["degree"], r["in_degree"], r["out_degree"]) for r in df.collect()}
    assert got == {(1, i): ((out[1, i] + into[1, i]) / 3, into[1, i] / 3, out[1, i] / 3) for i in range(4)} | {(2, 0): (1.0, 1.0, 1.0)}


def test_node_metrics_equal_their_parts(spark):
    got, degrees, between = ({(r["subject_id"], r["episode_index"]): r for r in QUERIES[n](spark, SF).collect()} for n in ("node_metrics", "degree_centrality", "betweenness_weighted"))
    assert got.keys() == degrees.keys() == between.keys()
    for k, r in got.items():
        assert [r[c] for c in ("degree", "in_degree", "out_degree", "betweenness")] == [*degrees[k][2:], between[k]["betweenness"]]
