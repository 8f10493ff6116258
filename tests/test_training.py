"""Splits with whole groups against a plain version, and a head against a plain solver."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import evaluation as E, training


def plain_split(rows, shares=(("train", 80), ("validation", 10), ("test", 10))):
    counts = defaultdict(Counter)
    for group, label in rows:
        counts[group][label] += 1
    strata = defaultdict(list)
    for group, c in counts.items():
        main = min(c, key=lambda x: (-c[x], x is None, x or ""))
        key = "\0" if group is None else group
        strata[main].append((hashlib.md5(f"42:{key}".encode()).hexdigest(), group, c.total()))
    out = {}
    for groups in strata.values():
        total, at = sum(n for *_, n in groups), 0
        for _, group, n in sorted(groups, key=lambda g: g[0]):
            middle, end = 2 * at + n, 0
            for name, share in shares:
                end += share
                if middle * 100 < 2 * end * total:
                    out[group] = name
                    break
            else:
                out[group] = shares[-1][0]
            at += n
    return out


@pytest.fixture(scope="module")
def grouped():
    rng = random.Random(6)
    rows = []
    for g in range(500):
        label = rng.choice(["a", "a", "a", "b", "c", None])
        rows += [(None if g == 7 else f"g{g}", label if rng.random() < 0.97 else "b") for _ in range(rng.choice([1, 1, 2, 5, 20]))]
    return rows


def test_split_equals_a_plain_version(spark, grouped):
    df = spark.createDataFrame(grouped, "group string, label string")
    got = E.stratified_group_split(df, "group", "label").collect()
    assert Counter((r["group"], r["label"]) for r in got) == Counter(grouped)
    assert {r["group"]: r["split"] for r in got} == plain_split(grouped)
    assert E.split_leakage(E.stratified_group_split(df, "group", "label"), "group").count() == 0


def test_shares_are_within_a_group_of_the_quota(spark):
    rng = random.Random(7)
    rows = [(f"g{g}", "abc"[g % 3]) for g in range(600) for _ in range(rng.choice([1, 2, 9]))]
    got = E.stratified_group_split(spark.createDataFrame(rows, "group string, label string"), "group", "label").groupBy("label", "split").count().collect()
    totals = Counter(label for _, label in rows)
    quota = {"train": 0.8, "validation": 0.1, "test": 0.1}
    assert len(got) == 9 and all(abs(r["count"] - quota[r["split"]] * totals[r["label"]]) <= 9 for r in got)


def plain_head(x, y, n_classes, decay, rounds=60):
    """Newton's method on the same objective, with the whole Hessian."""
    x = np.column_stack([x, np.ones(len(x))])
    n, d = x.shape
    w, ridge = np.zeros((n_classes, d)), np.tile(np.append(np.full(d - 1, decay), 0), n_classes)
    for _ in range(rounds):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = ((p - np.eye(n_classes)[y]).T @ x / n).ravel() + ridge * w.ravel()
        hessian = np.diag(ridge + 1e-12)
        for a in range(n_classes):
            for b in range(n_classes):
                hessian[a * d : a * d + d, b * d : b * d + d] += (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x / n
        w -= np.linalg.lstsq(hessian, gradient, rcond=None)[0].reshape(w.shape)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + np.eye(4)[y] * 1.5
    rows = [(x[i].tolist(), "abc"[y[i]]) for i in range(300)] + [(None, "a"), ([0.0] * 4, None), ([9.0] * 4, "other")]
    return x, y, spark.createDataFrame(rows, "v array<double>, label string").repartition(5)


def test_head_equals_a_plain_solver(spark, labelled):
    x, y, rows = labelled
    head = training.train_head(rows, "v", "label", ("a", "b", "c"), decay=0.01)
    want = plain_head(x, y, 3, 0.01)
    centred = lambda w: w - np.pad(w[:, -1:].mean(0, keepdims=True), ((0, 0), (4, 0)))  # the intercepts may shift together
    assert np.abs(centred(head.weights) - centred(want)).max() < 1e-4
    got = [r["p"] for r in rows.filter("label IN ('a', 'b', 'c') AND v IS NOT NULL").select(head.predicted(F.col("v")).alias("p"), "v").collect()]
    vectors = np.array([r["v"] for r in rows.filter("label IN ('a', 'b', 'c') AND v IS NOT NULL").select("v").collect()])
    assert got == ["abc"[i] for i in np.argmax(np.column_stack([vectors, np.ones(len(vectors))]) @ head.weights.T, axis=1)]


def test_only_a_head_that_passes_is_promoted(spark, labelled, tmp_path):
    _, _, rows = labelled
    rows = rows.filter("label IN ('a', 'b', 'c') AND v IS NOT NULL")
    path, classes = f"{tmp_path}/heads", ("a", "b", "c")
    assert training.current(spark, path, "m") is None
    first = training.train_head(rows, "v", "label", classes, decay=0.5, tolerance=1e-2)
    rotated = rows.withColumn("label", F.translate("label", "abc", "bca"))
    easy = rows.withColumn("label", first.predicted(F.col("v")))
    assert training.promote(spark, path, "m", first, easy, rows, "v", "label")
    assert not training.promote(spark, path, "m", first, rotated, rows, "v", "label")
    assert not training.promote(spark, path, "m", first, easy, rotated, "v", "label")
    second = training.Head(classes, first.weights * 2)
    assert training.promote(spark, path, "m", second, easy, easy, "v", "label")
    assert np.array_equal(training.current(spark, path, "m").weights, second.weights)
    with pytest.raises(ValueError, match="no row"):
        training.train_head(rows.limit(0), "v", "label", classes)
