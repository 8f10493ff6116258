"""Slopes that lie on a threshold fall on the side that their SQL puts them."""

import duckdb
import pytest

from tideline.operators import signatures as S
from tideline.plans.place_queries import ORACLES, QUERIES
from tideline.sources.adapters import table

SF = "/root/testdata/sf0.1"
#: Subjects with a slope of a hundredth, up or down, to the last bits.
SUBJECTS = (138, 677, 1127)


@pytest.fixture
def few(spark, tmp_path):
    table(spark, SF, "events").filter(f"user_id IN {SUBJECTS}").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["recovery_correlations", "trajectory_summary", "place_trajectory"])
def test_borderline_slopes(spark, few, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{few}/events.parquet/*.parquet')")
        got = con.execute(ORACLES[name])
        columns, want = [c[0] for c in got.description], got.fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, few).select(*columns).collect())) == sorted(want)


def test_slopes_of_missing_and_single_visits(spark):
    rows = [(1, "a", 5, 1, None), (1, "a", 6, 2, 1.0), (2, "a", 1, 3, 1.0)]
    visits = spark.createDataFrame(rows, "subject_id long, place_type string, us long, seq long, Hope double")
    for d in S.DIMENSIONS:
        visits = visits if d == "Hope" else visits.withColumn(d, visits["Hope"] * 0)
    assert {r["subject_id"]: (r["visit_count"], r["Hope"]) for r in S.trajectories(visits).collect()} == {1: (2, 1.0), 2: (1, 0.0)}
