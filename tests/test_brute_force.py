"""Operators without SQL against plain versions that follow their definitions."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import corrections, frames as FR, graphs, segments, trends

CLASSES = ("positive", "neutral", "negative")


def shortest_paths(n, edges, s, t):
    """All shortest paths from s to t as node lists, by trying every path."""
    best, found = float("inf"), []

    def walk(path, length):
        nonlocal best, found
        if path[-1] == t:
            if length < best:
                best, found = length, []
            if length == best:
                found.append(path)
            return
        for (a, b), w in edges.items():
            if a == path[-1]:
                walk([*path, b], length + w)

    walk([s], 0.0)
    return found


@pytest.mark.parametrize("distance", ["weight", "1-weight", "hop"])
def test_betweenness_against_all_paths(spark, distance, monkeypatch):
    """Random graphs, a chain, a diamond and an edge of no length; one or two sources in a block."""
    monkeypatch.setattr(graphs, "SOURCES", 2)
    monkeypatch.setattr(graphs, "CELLS", 10)
    rng = random.Random(6)
    cases = {1: (3, {(0, 1): 1.0, (1, 2): 1.0}), 2: (4, {(0, 1): 0.5, (0, 2): 0.5, (1, 3): 0.5, (2, 3): 0.5}), 3: (4, {(0, 1): 0.0, (1, 2): 1.0, (0, 2): 1.0, (2, 3): 0.0}), 4: (1, {}), 5: (3, {})}
    for k in range(6, 14):
        n = rng.randrange(2, 8)
        cases[k] = (n, {e: rng.choice([0.0, 0.25, 0.5, 1.0]) for e in itertools.combinations(range(n), 2) if rng.random() < 0.6})
    nodes = spark.createDataFrame([(k, i * 10) for k, (n, _) in cases.items() for i in range(n)], "subject_id long, episode_index long")
    lines = spark.createDataFrame([(k, a * 10, b * 10, w) for k, (_, es) in cases.items() for (a, b), w in es.items()], "subject_id long, source_index long, target_index long, weight double")
    got = {(r["subject_id"], r["episode_index"] // 10): r["betweenness"] for r in graphs.betweenness(nodes, lines, distance).collect()}
    want = {}
    for k, (n, es) in cases.items():
        lengths = {e: {"weight": w, "1-weight": 1 - w, "hop": 1.0}[distance] for e, w in es.items()}
        share = [0.0] * n
        for s, t in itertools.permutations(range(n), 2):
            paths = shortest_paths(n, lengths, s, t)
            for p in paths:
                for v in p[1:-1]:
                    share[v] += 1 / len(paths)
        want |= {(k, v): share[v] / ((n - 1) * (n - 2)) if n > 2 else share[v] for v in range(n)}
    assert got == pytest.approx(want)
    assert got[1, 1] == 0.5 and got[4, 0] == 0.0


def test_betweenness_of_long_chains_and_many_stretches(spark, monkeypatch):
    """A chain of 2,000 nodes in blocks of few sources, and a subject of chains of seven nodes that nothing joins: the nodes
    before a node times those after it, inside its chain."""
    monkeypatch.setattr(graphs, "CELLS", 100_000)
    chains = spark.sql("SELECT subject, id, IF(subject = 1, 2000L, 7L) AS n FROM range(2000) JOIN VALUES (1L), (2L) AS s(subject)")
    chains = chains.withColumn("at", F.col("id") % F.col("n"))
    nodes = chains.select(F.col("subject").alias("subject_id"), F.col("id").alias("episode_index"))
    lines = chains.filter("at < n - 1 AND id < 1999").selectExpr("subject AS subject_id", "id AS source_index", "id + 1 AS target_index", "0.5D AS weight")
    inside = F.least("n", 2000 - (F.col("id") - F.col("at")))
    want = chains.select(F.col("subject").alias("subject_id"), F.col("id").alias("episode_index"), (F.col("at") * (inside - 1 - F.col("at")) / (1999 * 1998)).alias("want"))
    got = graphs.betweenness(nodes, lines).join(want, ["subject_id", "episode_index"])
    assert got.count() == 4000 and got.filter("abs(betweenness - want) > 1e-12").count() == 0
    lows = graphs.stretches(nodes.withColumnRenamed("episode_index", "node"), lines.selectExpr("subject_id", "source_index AS source", "target_index AS target"))
    assert {(r["subject_id"], r["c"]) for r in lows.groupBy("subject_id").agg(F.count_distinct("low").alias("c")).collect()} == {(1, 1), (2, 286)}


def test_an_edge_that_leads_back_is_refused(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "subject_id long, episode_index long")
    lines = spark.createDataFrame([(1, 1, 0, 1.0)], "subject_id long, source_index long, target_index long, weight double")
    with pytest.raises(Exception, match="lower index"):
        graphs.betweenness(nodes, lines).collect()


def test_cycles_of_any_length(spark):
    """A ring of five labels, a loop, and a subject with more cycles than are reported."""
    ring = "abcde"
    steps = [(1, x, y) for x, y in zip(ring, ring[1:] + ring[:1], strict=True)] + [(1, "c", "c")]
    steps += [(2, x, y) for x in "pqrst" for y in "pqrst"]
    edges = spark.createDataFrame(steps, "subject_id long, source_label string, target_label string")
    assert {r["cycle"] for r in graphs.label_cycles(edges).filter("subject_id = 1").collect()} == {"a>b>c>d>e", "c"}
    want = {">".join(p) for n in range(1, 6) for p in itertools.permutations("pqrst", n) if p[0] == min(p)}
    got = [r["cycle"] for r in graphs.label_cycles(edges, None).filter("subject_id = 2").collect()]
    assert set(got) == want and len(got) == len(want)
    shortest = sorted(want, key=lambda c: (len(c), c))[:20]
    assert {r["cycle"] for r in graphs.label_cycles(edges).filter("subject_id = 2").collect()} == set(shortest)


def test_components_follow_the_edges(spark):
    """The running sum of the summary gives the components that the edges have."""
    from tideline.plans import graph_queries as Q

    sf = "/root/testdata/sf0.001"
    root: dict = {}
    for r in Q.episodes(spark, sf).collect():
        root[r["subject_id"], r["episode_index"]] = (r["subject_id"], r["episode_index"])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in Q.edges(spark, sf).collect():
        a, b = (find((r["subject_id"], r[c])) for c in ("source_index", "target_index"))
        root[max(a, b)] = min(a, b)
    want: dict = {}
    for x in root:
        want.setdefault(x[0], set()).add(find(x))
    got = {r["subject_id"]: r["component_count"] for r in graphs.graph_summary(Q.episodes(spark, sf), Q.edges(spark, sf), Q.NEAR).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def run_of(rows, kind):
    best = now = 0
    for r in rows:
        now = now + 1 if r["dominant"] == kind else 0
        best = max(best, now)
    return best


def plain_timeline(rows, size_us):
    """One subject's frames by the rules, window after window."""
    rows = sorted(rows, key=lambda r: (r["us"], r["seq"]))
    for r in rows:
        r["dominant"] = max(CLASSES, key=lambda c: r[c])
    windows = []
    for r in rows:
        if not windows or r["us"] - windows[-1][0]["us"] >= size_us:
            windows.append([])
        windows[-1].append(r)
    out, before = [], None
    for i, w in enumerate(windows):
        weight = [1 - r["uncertainty"] for r in w]
        p = {c: sum(r[c] * x for r, x in zip(w, weight, strict=True)) / sum(weight) for c in CLASSES} if sum(weight) > 0 else {"positive": 0.0, "neutral": 1.0, "negative": 0.0}
        fluctuates = len(w) < 2 or sum((r["positive"] - p["positive"]) ** 2 for r in w) / len(w) > 0.01
        others = p["positive"] + p["negative"]
        if (sum(r["uncertainty"] for r in w) / len(w) > 0.1 or fluctuates) and p["neutral"] < 0.5 and others > 0:
            scale = (others - (0.5 - p["neutral"])) / others
            p = {"positive": p["positive"] * scale, "neutral": 0.5, "negative": p["negative"] * scale}
        if run_of(w, "negative") >= 3 and p["negative"] > 0.15 and p["neutral"] > p["negative"]:
            led = [r["negative"] for r in w if r["dominant"] == "negative"]
            p["negative"] = max(p["negative"], 0.8 * sum(led) / len(led))
        if before:
            for c in CLASSES:
                most = before[c] + 0.1
                if p[c] > most:
                    over, p[c] = p[c] - most, most
                    p["neutral"] = min(1.0, p["neutral"] + over * 0.5)
            total = sum(p.values())
            p = {c: v / total for c, v in p.items()}
        top = max(CLASSES, key=lambda c: p[c])
        label = top if p[top] >= 0.45 and (top == "neutral" or run_of(w, top) >= 3) else "neutral"
        sources = [r["source_id"] for r in w if r["source_id"]][:3]
        out.append((i, w[0]["us"], label, p[label], *(p[c] for c in CLASSES), sum(weight) / len(w), len(w), ":".join(sources)))
        before = p
    return out


def test_frame_timeline_against_the_rules(spark):
    rng = random.Random(9)
    rows = []
    for subject in range(6):
        us = 0
        for seq in range(120):
            us += rng.randrange(1, 1_500_000)
            lean = rng.choice([(1, 1, 1), (1, 1, 6), (6, 1, 1), (0, 1, 8)] if subject % 2 else [(1, 1, 6)] * 5 + [(3, 2, 1)] if subject else [(9, 1, 1)])
            raw = [x + rng.random() / 4 for x in lean]
            rows.append((subject, us, seq, *(x / sum(raw) for x in raw), rng.choice([0.0, 0.05, 0.3, 1.0] if subject != 3 else [0.02]), rng.choice(["s%d" % seq, "", None])))
    names = ("subject_id", "us", "seq", "positive", "neutral", "negative", "uncertainty", "source_id")
    df = spark.createDataFrame(rows, "subject_id long, us long, seq long, positive double, neutral double, negative double, uncertainty double, source_id string").repartition(5)
    got: dict = {}
    for r in FR.frame_timeline(df).orderBy("window_index").collect():
        got.setdefault(r["subject_id"], []).append(tuple(r)[1:])
    labels = set()
    for subject in range(6):
        want = plain_timeline([dict(zip(names, r, strict=True)) for r in rows if r[0] == subject], 3_000_000)
        assert len(want) == len(got[subject])
        for a, b in zip(got[subject], want, strict=True):
            assert a[:3] == b[:3] and a[-2:] == b[-2:] and a[3:-2] == pytest.approx(b[3:-2], abs=6e-5)
            labels.add(a[2])
    assert labels == set(CLASSES)


def test_a_user_who_keeps_trying_is_let_in_again(spark):
    """Refused attempts are not stored and don't count."""
    rows = [(1, t * 60, t) for t in range(100)] + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "subject_id long, us long, seq long")
    got = corrections.rate_limited(df, most=10, within_us=3600).collect()
    allowed = [r["us"] // 60 for r in got if r["allowed"] and r["subject_id"] == 1]
    assert sorted(allowed) == [*range(10), *range(61, 71)] and max(r["in_last_hour"] for r in got) == 10


def test_means_skip_nulls(spark):
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate([None, 4.0, None, 1.0])], "subject_id long, us long, seq long, v double")
    got = [r["ema"] for r in trends.exponential_mean(df, F.col("v"), 3).orderBy("seq").collect()]
    assert got == [None, 4.0, 4.0, pytest.approx((0.25 * 4 + 0.5) / 0.75)]


def test_broken_episodes(spark):
    episodes = spark.createDataFrame([(1, 0, 10, 20), (1, 1, 30, 25), (2, 0, 0, 9)], "subject_id long, episode_index long, start_us long, end_us long")
    events = spark.createDataFrame([(1, 0, 9, 0), (1, 0, 15, 1), (1, 0, 12, 2), (1, 0, 20, 3), (2, 0, 0, 0), (2, 0, 0, 1)], "subject_id long, episode_index long, us long, seq long")
    got = {(r["subject_id"], r["episode_index"], r["problem"]): r["n"] for r in segments.episode_violations(episodes, events).collect()}
    assert got == {(1, 1, "start after end"): 1, (1, 0, "event before start"): 1, (1, 0, "event at or after end"): 1, (1, 0, "events out of order"): 1}


def test_percentages_round_half_up(spark):
    episodes = spark.createDataFrame([(1, 0), (1, 1)], "subject_id long, episode_index long")
    rows = [(1, 0, 0.125, 0.5, 0.375), (1, 0, 0.125, 0.5, 0.375), (1, 0, None, 1.0, 1.0)]
    got = segments.episode_percentages(episodes, spark.createDataFrame(rows, "subject_id long, episode_index long, positive double, neutral double, negative double"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 13, 50, 38), (1, 1, 0, 0, 0)]
