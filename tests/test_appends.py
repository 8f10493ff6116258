"""Appends, ingest and rate limits on streams: replays, failures, late rows and orders of arrival."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import corrections
from tideline.sources import appends
from tideline.streaming import limits, online


def rows(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)


def test_ids_have_no_gaps(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert appends.append(spark, path, rows(spark, range(10))) == (1, 10)
    assert appends.append(spark, path, rows(spark, []), "none") == (11, 10)
    assert appends.append(spark, path, rows(spark, range(100, 117), 7), "b") == (11, 27)
    got = appends.read(spark, path, "v long").collect()
    assert sorted(r["id"] for r in got) == list(range(1, 28))
    assert {r["v"] for r in got if r["id"] <= 10} == set(range(10)) and {r["version"] for r in got} == {0, 2}
    assert [(r["version"], r["batch"], r["first_id"], r["n_rows"]) for r in appends.commits(spark, path).orderBy("version").collect()] == [(0, None, 1, 10), (1, "none", 11, 0), (2, "b", 11, 17)]


def test_a_batch_is_appended_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = appends.sink(path, "s", lambda df: df.withColumn("v", F.col("v") * 2))
    for number in (0, 0, 1, 0, 1):
        write(rows(spark, range(number * 10, number * 10 + 4)), number)
    got = appends.read(spark, path, "v long").collect()
    assert sorted((r["id"], r["version"]) for r in got) == [(i + 1, i // 4) for i in range(8)]
    assert sorted(r["v"] for r in got) == [0, 2, 4, 6, 20, 22, 24, 26]
    assert appends.append(spark, path, rows(spark, [7]), "s:0") == (1, 4)


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    appends.append(spark, path, rows(spark, range(3)), "a")
    bad = rows(spark, range(50)).withColumn("v", F.when(F.col("v") == 40, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        appends.append(spark, path, bad, "b")
    # Written, but stopped before its record: seen by no reader, and its version and ids are used again.
    real, calls = type(spark).createDataFrame, []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: calls.append(1) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        appends.append(spark, path, rows_of(real, spark, range(60, 90)), "c")
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    assert calls and appends.read(spark, path, "v long").count() == 3
    assert appends.append(spark, path, rows(spark, range(5)), "d") == (4, 8)
    assert sorted(r["v"] for r in appends.read(spark, path, "v long").collect()) == [0, 0, 1, 1, 2, 2, 3, 4]


def rows_of(create, spark, values):
    return create(spark, [(v,) for v in values], "v long")


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    appends.append(spark, path, rows(spark, [1]))
    old = appends.commits(spark, path)
    stale = spark.createDataFrame(old.collect(), appends.COMMIT)
    appends.append(spark, path, rows(spark, [2]))
    monkeypatch.setattr(appends, "commits", lambda *_: stale)
    with pytest.raises(Exception, match="(?i)exist"):
        appends.append(spark, path, rows(spark, [3]))


def test_nothing_is_there_yet(spark, tmp_path):
    assert appends.read(spark, f"{tmp_path}/none", "v long").columns == ["id", "v", "version"]
    assert appends.read(spark, f"{tmp_path}/none", "v long").count() == 0


def test_posts_with_problems(spark):
    posts = [("u", "a.png", "hi"), ("u", "a.PNG.gif", "hi"), ("", "a.png", None), (None, None, "x"), ("u", "noext", "x"), ("u", "a.exe", "x")]
    got = appends.checked_posts(spark.createDataFrame(posts, "user_id string, image_path string, caption string")).collect()
    assert [r["problem"] for r in got] == [None, None, "Missing required fields: caption, user_id", "Missing required fields: image, user_id", "Unsupported file extension", "Unsupported file extension"]


def test_keyword_lists(spark):
    pushes = [(3, "u", "positive", "c"), (1, "u", "positive", "a"), (2, "u", "positive", "a"), (4, "w", "negative", "z"), (5, "x", "other", "z")]
    got = {r["user_id"]: (r["positive_keywords"], r["negative_keywords"]) for r in appends.keyword_lists(spark.createDataFrame(pushes, "id long, user_id string, kind string, keyword string")).collect()}
    assert got == {"u": (["a", "a", "c"], []), "w": ([], ["z"])}


def files(spark, path, batches, columns):
    """A stream of files that arrive one after the other."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, columns).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{path}/in/part={i:03}")
    return spark.readStream.schema(f"{columns}, ts timestamp, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in").drop("part")


HOUR = corrections.HOUR_US


def test_ingest_counts_late_rows_and_drops_repeated_ones(spark, tmp_path):
    batches = [[(1, 10 * HOUR), (2, 11 * HOUR)], [(2, 11 * HOUR), (3, 20 * HOUR)], [(4, 30 * HOUR)], [(5, 2 * HOUR), (3, 20 * HOUR), (6, 31 * HOUR)], [(7, 31 * HOUR)]]
    stream = files(spark, str(tmp_path), batches, "k long, us long")
    query = online.ingest(stream, "k", f"{tmp_path}/table", str(tmp_path), "5 hours")
    got = appends.read(spark, f"{tmp_path}/table", "k long, us long").collect()
    assert sorted(r["k"] for r in got) == [1, 2, 3, 4, 6, 7] and sorted(r["id"] for r in got) == list(range(1, 7))
    assert online.late_rows(query) == 1  # 5 came after the watermark of the batch before; the third 3 is a repetition
    again = online.ingest(stream, "k", f"{tmp_path}/table", str(tmp_path), "5 hours")
    assert appends.read(spark, f"{tmp_path}/table", "k long, us long").count() == 6 and online.late_rows(again) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_limits_in_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    attempts = [(rng.choice([1, 1, 2, 3]), i, rng.randrange(30 * HOUR) if i % 3 else 5 * HOUR + rng.randrange(600_000_000)) for i in range(240)]
    shuffled = sorted(attempts, key=lambda a: a[2] + rng.randrange(4 * HOUR))  # at most four hours late
    batches = [shuffled[i : i + 40] for i in range(0, 240, 40)] + [[(-1, -1, 1000 * HOUR)]]
    stream = files(spark, str(tmp_path), batches, "subject_id long, seq long, us long")
    got = online.run_to_end(limits.rate_limited(stream, "5 hours", 3), str(tmp_path)).filter("subject_id > 0").collect()
    want = corrections.rate_limited(spark.createDataFrame(attempts, "subject_id long, seq long, us long"), 3).select("subject_id", "seq", "us", "in_last_hour", "allowed").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r["allowed"] for r in got} == {True, False}
