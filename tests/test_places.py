"""Places against all pairs: the grid anywhere on the globe, similar places, clusters of classes, silhouettes."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import pytest

from tideline.operators import places
from tideline.plans import place_queries
from tideline.sources.tables import cut


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("reach", [50.0, 20_000.0, 1_500_000.0, 12_000_000.0])
def test_near_anywhere(spark, reach):
    rng = random.Random(int(reach))
    step = min(reach / 111_000, 40)
    spots = [(90.0, 0.0), (-90.0, 12.0), (89.9999, 180.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.9999), (10.0, -179.9999), (100.0, 0.0), (float("nan"), 0.0), (None, 1.0)]
    for _ in range(40):
        lat, lon = rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)), (rng.uniform(-60, 60), rng.choice([-180, 180]))])
        spots += [(max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * step)), (lon + rng.uniform(-1, 1) * step / max(0.01, math.cos(math.radians(lat))) + 540) % 360 - 180) for _ in range(4)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "place_id long, lat double, lon double")
    good = [i for i, (lat, lon) in enumerate(spots) if lat is not None and -90 <= lat <= 90]
    want = {(i, j) for i, j in itertools.combinations(good, 2) if metres(spots[i], spots[j]) <= reach}
    got = [(r["a"], r["b"]) for r in places.near_pairs(df, reach).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    around = places.nearby(df.filter("place_id % 3 = 0").withColumnRenamed("place_id", "target_id"), df, reach)
    both = want | {(j, i) for i, j in want}
    assert sorted((r["target_id"], r["place_id"]) for r in around.collect()) == sorted((i, j) for i, j in both if i % 3 == 0 and spots[i] != spots[j])


def composite(a, b):
    (t, g, x, *at), (u, h, y, *bt) = a[1:], b[1:]
    cat = 0.0 if not t or not u else 1.0 if t == u else 0.5 if {t, u} == {"cafe", "restaurant"} else 0.0
    cult = len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0
    return 0.3 * math.exp(-3 * metres(at, bt) / 1000 / 500) + 0.4 * cat + 0.15 * bool(g and g == h) + 0.15 * cult


@pytest.fixture(scope="module")
def some():
    rng = random.Random(4)
    return [(i, rng.choice(["cafe", "restaurant", "park", None]), rng.choice(["en", "de", ""]), rng.sample(["a", "b", "c"], rng.randrange(3)), rng.uniform(40, 46), rng.uniform(-3, 3)) for i in range(120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double")


def test_similar_places(spark, some):
    df = frame(spark, some)
    got = {(r["place_id_a"], r["place_id_b"]): r["proximity"] for r in places.similar_to(df.filter("place_id % 4 = 0"), df, 0.72).collect()}
    want = {(a[0], b[0]): composite(a, b) for a in some for b in some if a[0] % 4 == 0 and a[0] != b[0] and composite(a, b) >= 0.72}
    assert got == pytest.approx(want) and len(want) > 20


def plain_dbscan(ids, links, least):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    core = {i for i in ids if len(near[i]) + 1 >= least}
    label = {}
    for i in sorted(core):
        stack = [i] if i not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += [y for y in near[x] if y in core]
    return {i: label.get(i, min((label[y] for y in near[i] if y in core), default=-1)) for i in ids}


@pytest.mark.parametrize(("least", "samples"), [(0.68, 2), (0.68, 4), (0.71, 3), (0.86, 2), (0.97, 2)])
def test_clusters_of_classes(spark, some, least, samples):
    """Also where a class doesn't hold together by its attributes, and for border points."""
    got = {r["place_id"]: r["cluster_id"] for r in places.semantic_clusters(frame(spark, some), least, samples, cut).collect()}
    links = [(a[0], b[0]) for a, b in itertools.combinations(some, 2) if composite(a, b) >= least]
    assert got == plain_dbscan([r[0] for r in some], links, samples)
    pairs = spark.createDataFrame([(a, b, 0.1) for a, b in links] + [(0, 1, 0.9)], "a long, b long, distance double")
    again = places.dbscan(pairs, frame(spark, some), 0.5, samples, cut)
    assert {r["place_id"]: r["cluster_id"] for r in again.collect()} == got


def test_silhouette(spark):
    spots = {1: (0, 0), 2: (0, 1), 3: (5, 0), 4: (5, 1), 5: (9, 9), 6: (2, 0)}
    cluster = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: -1}
    pairs = [(a, b, math.dist(spots[a], spots[b])) for a, b in itertools.combinations(spots, 2)]
    got = places.silhouette(spark.createDataFrame(pairs, "a long, b long, distance double"), spark.createDataFrame(list(cluster.items()), "place_id long, cluster_id long")).collect()
    want = {}
    for i, c in cluster.items():
        if c == -1:
            continue
        mean = {d: [math.dist(spots[i], spots[j]) for j, e in cluster.items() if e == d and j != i] for d in {1, 3, 5}}
        own, other = mean.pop(c), min(sum(m) / len(m) for m in mean.values() if m)
        want[i] = (other - sum(own) / len(own)) / max(other, sum(own) / len(own)) if own else 0.0
    assert {r["place_id"]: r["silhouette"] for r in got} == pytest.approx(want)


def test_davies_bouldin_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, c * 3 + rng.random(), c % 5 + rng.random()) for c in range(23) for _ in range(4)]
    df = spark.createDataFrame(rows, "cluster_id long, x double, y double")
    whole = places.davies_bouldin(df).first()[0]
    monkeypatch.setattr(places, "BLOCK", 5)
    assert places.davies_bouldin(df).first()[0] == pytest.approx(whole)
    assert places.davies_bouldin(df.filter("cluster_id = 1")).first()[0] is None


def test_weightings():
    assert {k: sum(w) for k, w in place_queries.SCENARIOS.items()} == pytest.approx(dict.fromkeys(("Default", "Geographic Focus", "Categorical Focus", "Cultural Focus", "Equal Weights"), 1.0))
    assert place_queries.SCENARIOS["Cultural Focus"] == (0.1, 0.2, 0.2, 0.5)


def test_no_nested_loops(spark):
    """Places meet by equal keys: no plan compares all with all."""
    sf = "/root/testdata/sf0.001"
    for name in ("nearby_places", "near_place_pairs", "similar_place_patterns"):
        plan = place_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_dense_cells_make_few_links(spark, monkeypatch):
    """Two classes of 200 places in one spot have 40,000 links, of which one joins them."""
    rows = [(i, "Park", "ASIA", ["a", f"t{i % 2}", "c"], 10.0 + i % 20 / 1000, 20.0 + i // 20 / 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double")
    made, inner = [], places._open_links
    monkeypatch.setattr(places, "_open_links", lambda *a: made.append(inner(*a)) or made[-1])
    assert {r["cluster_id"] for r in places.semantic_clusters(df, 0.68, 2, cut).collect()} == {0}
    assert 1 <= made[0].count() <= 16
