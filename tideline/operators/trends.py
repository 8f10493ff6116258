"""Mood over time: running sums, rolling and exponential means, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.operators.ordered import ordered_fold
from tideline.operators.timeline import ordered


def cumulative(rows: DataFrame, value: Column) -> DataFrame:
    """Running sum; a null value leaves null at its row and is skipped by later ones."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative", F.when(value.isNotNull(), F.sum(value).over(w)))


def rolling_mean(rows: DataFrame, value: Column, width: int = 5) -> DataFrame:
    return rows.withColumn("rolling", F.avg(value).over(ordered().rowsBetween(1 - width, 0)))


def exponential_mean(rows: DataFrame, value: Column, span: int = 5) -> DataFrame:
    """``subject_id us seq ema``, y = a x + (1 - a) y before, with a = 2 / (span + 1) and y = x at first.

    A fold in order: a null carries the last value on while older weights decay."""
    alpha = 2.0 / (span + 1)

    def step(state, x):
        y, old = state
        if x is None:
            return (y, old if y is None else old * (1 - alpha)), (y,)
        if y is None:
            return (x, 1.0), (x,)
        old *= 1 - alpha
        y = (old * y + alpha * x) / (old + alpha)
        return (y, 1.0), (y,)

    kept = rows.select("subject_id", "us", "seq", value.cast("double").alias("v"))
    return ordered_fold(kept, "subject_id", ["us", "seq"], ["v"], lambda: (None, 1.0), step, "ema double").drop("v")


def latest(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("subject_id").agg(F.max_by(F.struct(*columns), F.struct("us", "seq")).alias("r")).select("subject_id", *(f"r.{c}" for c in columns))


def chime_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per subject a count for each dimension, zeros too; a non-empty correction replaces the prediction."""
    label = F.lower(F.coalesce(F.when(F.col("corrected_label") != "", F.col("corrected_label")), F.col("predicted_label")))
    return rows.groupBy("subject_id").agg(*(F.count_if(label == d.lower()).alias(d) for d in dimensions))
