"""Pairs of many rows: how they are made, and their parts against plain ones."""

import random

import pytest

from tideline.operators import places as P


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_places(spark, tags):
    pick = random.Random(3)
    rows = [(i, pick.choice(["cafe", "restaurant", "park"]), pick.choice(["x", "y", ""]), pick.sample(tags, pick.randint(0, 3)), pick.uniform(-80, 80), pick.uniform(-179, 179)) for i in range(60)]
    return spark.createDataFrame(rows, "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double"), {r[0]: r for r in rows}


@pytest.mark.parametrize("n_tags", [5, 150, 600])
def test_place_pairs_have_the_parts_of_their_tags(spark, monkeypatch, n_tags):
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "MASKS", 3 if n_tags < 600 else 1)
    places, rows = some_places(spark, [f"t{i}" for i in range(n_tags)])
    got = P.place_pairs(places.filter("place_id % 10 = 0"), places).select("place_id_a", "place_id_b", "cultural").collect()
    assert sorted((r[0], r[1]) for r in got) == [(a, b) for a in range(0, 60, 10) for b in range(60) if a != b]
    for a, b, value in got:
        x, y = set(rows[a][3]), set(rows[b][3])
        assert value == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_place_pairs_are_not_sorted_and_meet_in_many_tasks(spark):
    places, _ = some_places(spark, ["a", "b", "c", "d"])
    got = P.place_pairs(places.filter("place_id % 10 = 0"), places)
    joins = [line for line in plan_of(got).splitlines() if "Join" in line and "__meet" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
    assert got.rdd.getNumPartitions() >= 4 and sum(1 for n in got.rdd.glom().map(len).collect() if n) >= 3


def test_an_invalid_place_is_an_error_of_its_pairs(spark):
    places = spark.createDataFrame([(100, "a", "x", ["t"], 95.0, 0.0), (1, "a", "x", ["t"], 0.0, 0.0)], "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double")
    with pytest.raises(Exception, match="invalid coordinates"):
        P.place_pairs(places.filter("place_id = 100"), places).collect()


def test_similar_places_are_those_of_all_places(spark):
    from compare import assert_same

    from tideline.plans.place_queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["similar_place_patterns"](spark, sf)
    assert got.filter("place_id_a % 100 <> 0 AND place_id_b % 100 <> 0").count() > 1000
    assert_same(got, ORACLES["similar_place_patterns"], sf)
