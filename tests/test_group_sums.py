"""Sums over groups of places equal those over their pairs, without a row per pair."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import places as P
from tideline.plans import place_queries

SCHEMA = "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double, kin long"
PARTS = ("geographic", "categorical", "linguistic", "cultural")


def test_group_sums_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "SUM_BLOCK", 3)
    monkeypatch.setattr(P, "TILE", (2, 5))
    rows = [(i, ["cafe", "restaurant", "park", None][i % 4], ["x", None][i % 2], [["a", "b"], ["b"], []][i % 3], i * 0.7 % 50, i * 1.3 % 60, i % 6) for i in range(70)]
    rows += [(100, "cafe", "x", ["b"], 10.0, 10.0, 77), (101, "cafe", "x", ["b"], 10.0, 10.0, 6), (102, "cafe", "x", ["b"], 10.0, 10.0, 6)]
    places = spark.createDataFrame(rows, SCHEMA)
    asked = places.filter("place_id % 10 = 0")
    kin = {r[0]: r[6] for r in rows}
    want = {}
    for a, b, *parts in P.place_pairs(asked, places).select("place_id_a", "place_id_b", *PARTS).collect():
        n, sums = want.get((a, kin[b]), (0, [0.0] * 4))
        want[a, kin[b]] = n + 1, [x + y for x, y in zip(sums, parts, strict=True)]
    got = {(r["place_id"], r["kin"]): (r["n"], [r[c] for c in PARTS]) for r in P.group_sums(asked, places, "kin").select("place_id", "kin", "n", *PARTS).collect()}
    assert (100, 77) not in want and set(got) == set(want)
    for k, (n, sums) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(sums, abs=1e-12)


def test_sums_have_no_row_per_pair(spark):
    plan = place_queries.QUERIES["weight_sensitivity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "atan2" not in plan.lower()


def test_an_invalid_place_is_an_error_of_its_sums(spark):
    places = spark.createDataFrame([(100, "a", "x", ["t"], None, 0.0, 1), (1, "a", "x", ["t"], 0.0, 0.0, 1)], SCHEMA)
    with pytest.raises(Exception, match="invalid coordinates"):
        P.group_sums(places.filter(F.col("place_id") == 100), places, "kin").collect()
