"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import evaluation, integrity, places


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tweet_tokens_are_masked(spark):
    assert one(spark, T.mask_tweet_tokens(F.lit("hi @bob see http://a.b @"))) == "hi @user see http @"


def test_softmax_sums_to_one(spark):
    got = one(spark, T.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))))
    assert sum(got) == pytest.approx(1) and got[0] == pytest.approx(got[1]) and got[2] == max(got)


def test_one_hot(spark):
    assert list(one(spark, T.one_hot(F.lit(2), 4))) == [0, 0, 1, 0]


def test_fenced_json(spark):
    assert one(spark, T.fenced_json(F.lit('say ```json\n{"a": 1}\n``` done'))).strip() == '{"a": 1}'


@pytest.mark.parametrize(("km", "share"), [(0.0, 1.0), (500.0, math.exp(-3))])
def test_distance_decay(spark, km, share):
    assert one(spark, places.distance_decay(F.lit(km))) == pytest.approx(share)


def test_neighbouring_places_are_metres_apart(spark):
    got = one(spark, places.haversine_m(F.lit(61.2181), F.lit(-149.9003), F.lit(61.2182), F.lit(-149.9004)))
    assert 10 < got < 20


def test_seconds_and_milliseconds_are_one_instant(spark):
    got = [one(spark, integrity.parse_timestamp(F.lit(v))) for v in ("1701432000", "1701432000000", "2023-12-01T12:00:00Z")]
    assert got[0] is not None and got[0] == got[1] == got[2]


@pytest.mark.parametrize(("path", "remote"), [("https://a/b.jpg", True), ("S3://a/b", True), ("ftp://a", True), ("images/http.jpg", False), ("file:///a", False)])
def test_remote_paths(spark, path, remote):
    assert one(spark, integrity.is_remote(F.lit(path))) is remote


def test_split_keeps_groups_together(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 40).alias("g"))
    got = evaluation.grouped_split(rows, F.col("g"))
    assert evaluation.split_leakage(got, "g").count() == 0


def test_groups_take_links_beyond_the_five_nearest(spark, tmp_path):
    """Two families of seven close texts whose only links to each other are no text's five nearest: one group."""
    import random

    from tideline.operators import dedupe
    from tideline.plans import text_queries

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = " ".join(word(9) for _ in range(80))
    rows = [(i, f"{base} {'quarrelsome' if i <= 7 else 'hydroponics'} {word(9)}") for i in range(1, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["group_id"] for r in text_queries.QUERIES["duplicate_groups"](spark, str(tmp_path)).collect()} == {1}
    pairs = dedupe.close_pairs(docs, "doc_id", "text").collect()
    assert len({(r["lo"], r["hi"]) for r in pairs}) == 14 * 13 // 2
