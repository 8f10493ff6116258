"""Similar places: what comes along with a pair needs no join of pairs."""

from tideline.operators import places as P
from tideline.plans import place_queries

SCHEMA = "place_id long, type string, language string, cultural_tags array<string>, lat double, lon double, mark string"


def test_pairs_are_not_joined_again(spark):
    plan = place_queries.QUERIES["similar_place_patterns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "__share" in next(line for line in plan.splitlines() if "Join" in line)


def test_columns_come_along(spark):
    rows = [(i, ["cafe", "park", None][i % 3], "x", ["a", f"t{i % 2}"], i * 0.01, 5.0, f"m{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {(r["place_id_a"], r["place_id_b"]) for r in P.place_pairs(df, df).collect() if 0.3 * r["geographic"] + 0.4 * r["categorical"] + 0.15 * r["linguistic"] + 0.15 * r["cultural"] >= 0.7 - 1e-12}
    got = P.similar_to(df, df, 0.7, keep=("mark",)).collect()
    assert {(r["place_id_a"], r["place_id_b"]) for r in got} == plain and len(got) == len(plain)
    assert all(r["mark_a"] == f"m{r['place_id_a']}" and r["mark_b"] == f"m{r['place_id_b']}" for r in got)
