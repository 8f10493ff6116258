"""A classifier head over vectors: softmax regression by L-BFGS, whose sums Spark gathers, and its promotion.

Each round reads the vectors once: a task adds up loss and gradient of its rows, Spark adds the tasks' sums by position,
and the driver takes the step. What reaches it is a gradient, classes times dimensions, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.text import softmax
from tideline.operators.corrections import promotion_gate
from tideline.sources import appends

MODEL = "name string, classes array<string>, weights array<array<double>>"


@dataclass(frozen=True)
class Head:
    """``weights`` has a row for each class: the dimensions and, last, the intercept."""

    classes: tuple[str, ...]
    weights: np.ndarray

    def scores(self, vector: Column) -> Column:
        rows = F.array(*(F.array(*map(F.lit, map(float, w))) for w in self.weights))
        dot = lambda w: F.aggregate(F.zip_with(F.concat(vector.cast("array<double>"), F.array(F.lit(1.0))), w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.transform(rows, dot)

    def probabilities(self, vector: Column) -> Column:
        """The classes' shares, in their order."""
        return softmax(self.scores(vector))

    def predicted(self, vector: Column) -> Column:
        """The class with the highest score; the first one on ties."""
        scores = self.scores(vector)
        return F.get(F.array(*map(F.lit, self.classes)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Summed loss, number of rows and gradient over ``rows`` (``y x``)."""
    n_classes, width = weights.shape

    def run(batches):
        total, seen, loss = np.zeros_like(weights), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), width - 1), np.ones(len(y))])
            z = x @ weights.T
            z -= z.max(axis=1, keepdims=True)
            log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            loss -= log[np.arange(len(y)), y].sum()
            p = np.exp(log)
            p[np.arange(len(y)), y] -= 1
            total += p.T @ x
            seen += len(y)
        values = np.concatenate([[loss, seen], total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    got = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # a row per weight
    values = np.zeros(2 + weights.size)
    for r in got:
        values[r["at"]] = r["value"]
    return values[0], int(values[1]), values[2:].reshape(n_classes, width)


def train_head(rows: DataFrame, vector: str, label: str, classes: tuple[str, ...], start: Head | None = None, decay: float = 1e-3, rounds: int = 100, tolerance: float = 1e-7, memory: int = 10) -> Head:
    """Softmax regression on mean loss plus ``decay`` / 2 times the squared weights, intercepts aside, until no part of
    the gradient is above ``tolerance``. Rows of other labels, and without a vector, are left out; there must be one."""
    ids = F.array(*map(F.lit, classes))
    used = rows.select((F.array_position(ids, F.col(label)) - 1).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x")).filter("y >= 0 AND x IS NOT NULL")
    width = used.select(F.size("x").alias("n")).first()
    if width is None:
        raise ValueError("no row has one of the classes and a vector")
    weights = np.zeros((len(classes), width["n"] + 1)) if start is None else start.weights.copy()
    decays = np.full_like(weights, decay)
    decays[:, -1] = 0

    def at(w):
        loss, n, gradient = _sums(used, w)
        return loss / n + 0.5 * (decays * w * w).sum(), gradient / n + decays * w

    value, gradient = at(weights)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= tolerance:
            break
        way, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s * way).sum() / (s * y).sum()
            way -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way += s * (a - (y * way).sum() / (s * y).sum())
        slope, length = (way * gradient).sum(), 1.0
        while True:  # halved until it falls enough; a step of that size is too small to matter in the end
            found = at(weights - length * way)
            if found[0] <= value - 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        s, y = -length * way, found[1] - gradient
        if (s * y).sum() > 1e-18:
            steps = [*steps, (s, y)][-memory:]
        weights, (value, gradient) = weights + s, found
    return Head(tuple(classes), weights)


def promote(spark: SparkSession, path: str, name: str, head: Head, anchors: DataFrame, fresh: DataFrame, vector: str, label: str) -> bool:
    """Appends ``head`` as the newest version of ``name`` if it passes the gate on both sets of labelled vectors."""
    judged = [df.select(F.col(label).alias("label"), head.predicted(F.col(vector)).alias("predicted")) for df in (anchors, fresh)]
    passed = bool(promotion_gate(*judged).first()["promote"])
    if passed:
        appends.append(spark, path, spark.createDataFrame([(name, list(head.classes), head.weights.tolist())], MODEL))
    return passed


def current(spark: SparkSession, path: str, name: str) -> Head | None:
    """The newest promoted version of ``name``."""
    row = appends.read(spark, path, MODEL).filter(F.col("name") == name).orderBy(F.desc("version")).first()
    return row and Head(tuple(row["classes"]), np.array(row["weights"]))
