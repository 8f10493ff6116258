"""The mix against a plain version, its flow against shortest paths over every arc, its targets by resharing."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing


def plain_targets(sizes, weights):
    """The excess above a cap is handed to the sources that are below theirs, until none is above."""
    want = {s: Fraction(3, 2) * sum(sizes.values()) * weights[s] / sum(weights.values()) for s in sizes}
    while any(want[s] > 2 * sizes[s] for s in sizes):
        excess = sum(max(Fraction(0), want[s] - 2 * sizes[s]) for s in sizes)
        want = {s: min(want[s], Fraction(2 * sizes[s])) for s in sizes}
        below = [s for s in sizes if want[s] < 2 * sizes[s]]
        for s in below:
            want[s] += excess * weights[s] / sum(weights[x] for x in below)
    return want


@pytest.mark.parametrize("seed", range(40))
def test_targets_by_resharing(seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 1000]) * rng.randrange(1, 9) for i in range(rng.randrange(1, 9))}
    assert mixing.targets(sizes, mixing.repeating(sizes)) == plain_targets(sizes, mixing.repeating(sizes))


def shortest_paths(patterns, quotas, uses):
    """Least-cost flow by Bellman-Ford over start, uses of patterns, sources and end, one word at a time: value and cost."""
    arcs = []  # tail, head, capacity left, cost; an arc and its reverse are neighbours

    def arc(u, v, cap, cost):
        arcs.extend([[u, v, cap, cost], [v, u, 0, -cost]])

    for p, n in patterns.items():
        for k in range(uses):
            arc("start", ("p", p), n, k)
        for s in p:
            arc(("p", p), ("s", s), 10**9, 0)
    for s, q in quotas.items():
        arc(("s", s), "end", q, 0)
    value = cost = 0
    while True:
        far, via, changed = {"start": 0}, {}, True
        while changed:
            changed = False
            for i, (u, v, cap, c) in enumerate(arcs):
                if cap and u in far and far[u] + c < far.get(v, 10**9):
                    far[v], via[v], changed = far[u] + c, i, True
        if "end" not in far:
            return value, cost
        at = "end"
        while at != "start":
            i = via[at]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            at = arcs[i][0]
        value, cost = value + 1, cost + far["end"]


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    sources = "abcd"[: rng.randrange(1, 5)]
    patterns = {tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))): rng.randrange(0, 7) for _ in range(rng.randrange(1, 7))}
    uses = rng.randrange(1, 4)
    quotas = {s: rng.randrange(0, 12) for s in {s for p in patterns for s in p}}
    flow = mixing.cheapest_flow(patterns, quotas, uses)
    taken = {p: sum(f.values()) for p, f in flow.items()}
    assert all(0 <= t <= uses * patterns[p] for p, t in taken.items()) and all(w >= 0 for f in flow.values() for w in f.values())
    assert all(sum(f.get(s, 0) for f in flow.values()) <= q for s, q in quotas.items())
    cost = sum(max(0, t - k * patterns[p]) for p, t in taken.items() for k in range(1, uses))
    assert (sum(taken.values()), cost) == shortest_paths(patterns, quotas, uses)


def plain_mix(rows):
    """Sizes, targets and words of ``(id, text, source)``, with the order of a source in one list."""
    sizes = defaultdict(int)
    docs = [(k, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for k, t, s in rows]
    for _, n, s in docs:
        sizes[s] += n
    want = plain_targets(sizes, mixing.repeating(sizes))
    out = []
    for source in sizes:
        goal = int(want[source])
        own = sorted((hashlib.md5(f"42:{'' if k is None else k}".encode()).hexdigest(), n, k) for k, n, s in docs if s == source)
        bounds = [max(goal // x, sizes[source] // 100_000, 1) for x in (10, 100, 1000)]
        tiers = [[d for d in own if sum(d[1] <= b for b in bounds) == k] for k in range(4)]
        for k, tier in enumerate(tiers):
            words, below = sum(d[1] for d in tier), sum(d[1] for t in tiers[k:] for d in t)
            part, at = max(0, goal) * words // below if words else 0, 0
            for _, n, key in tier:
                uses = sum(2 * (u * words + at) + n < 2 * part for u in range(2)) if n else 0
                out.append((key, n, sizes[source], float(want[source]), n * uses))
                at, goal = at + n, goal - n * uses
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(None, "a b", None), (1, None, "x"), (1, "", "x"), (2, "one two", None), (3, " \t", "only blank"), (4, "w " * 9000, "x"), (4, "w " * 9000, "x"), (5, "w", "ä")]
    for i in range(700):
        out.append((i, "w " * rng.choice([0, 1, 3, 30, 200, rng.randrange(1, 900)]), rng.choice(["x", "x", "x", "y", "z", "ä", None, "Z"])))
    return out + out[50:90]


def test_equals_a_plain_version(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("size", "key", "digest", "tier", "words", "sources", "routed")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op12_mixture(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_mix(rows)))
    assert sorted(map(repr, mixing.op12_mixture(spark, str(tmp_path)).collect())) == sorted(map(repr, got))
    by_target = defaultdict(int)
    for r in got:
        by_target[r["source_size"], r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken - target) <= 0.01 * target + 3 for (size, target), taken in by_target.items() if size > 1000)


def test_documents_of_several_sources(spark):
    """b alone can't be met by its own documents: shared ones go to b, and a takes its own; nothing is used twice."""
    rows = [(i, 10, s) for i, s in enumerate([["a"]] * 60 + [["b", "a", "b"]] * 50 + [["b"]] * 10 + [[], None])]
    docs = spark.createDataFrame(rows, "doc_id long, n long, s array<string>")
    got, quotas = mixing.mix(docs, lambda sizes: {"a": 500, "b": 550}, size=F.col("n"), sources=F.col("s"))
    words, out = defaultdict(int), got.collect()
    for r in out:
        assert r["taken"] in (0, 10) and set(x["source"] for x in r["routed"]) <= set(r["sources"])
        for x in r["routed"]:
            words[x["source"]] += x["words"]
    assert len(out) == len(rows) and quotas == words == {"a": 500, "b": 550}


def test_no_rows_and_too_many_patterns(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    assert mixing.mix(docs.limit(0), dict)[0].count() == 0
    monkeypatch.setattr(mixing, "PATTERNS", 4)
    with pytest.raises(ValueError, match="sets of sources"):
        mixing.mix(docs, dict)
