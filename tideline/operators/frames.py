"""Facial-estimate frames to timelines: greedy windows, weighted probabilities and the decision rules.

A frame is ``subject_id us seq positive neutral negative uncertainty source_id``. Windows are measured by aggregates;
only the starts of greedy windows and the rule that looks at the window before are folds in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scalars import argmax
from tideline.operators.ordered import ordered_fold

CLASSES = ("positive", "neutral", "negative")
WINDOW_S = 3.0
LIFT, UNCERTAIN, SPREAD = 0.5, 0.1, 0.01
RUN, NEGATIVE_LEAST, NEGATIVE_SHARE = 3, 0.15, 0.8
STEP = 0.1
DECIDE = 0.45


def with_defaults(outputs: DataFrame) -> DataFrame:
    """Model outputs with missing values filled: (0, 1, 0) and an uncertainty of 0.1."""
    fill = {"positive": 0.0, "neutral": 1.0, "negative": 0.0, "uncertainty": 0.1}
    return outputs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items()})


def from_outputs(outputs: DataFrame, base_us: int, step_us: int = 100_000) -> DataFrame:
    """Frames of model outputs (``subject_id seq timestamp positive neutral negative uncertainty image_id source_id``) with
    defaults, the picture's name before the source's, and ``us``. An output without a time stands a tenth of a second
    after the one before from ``base_us`` on, by ``seq`` from 0."""
    us = F.coalesce(F.unix_micros(F.try_to_timestamp("timestamp")), F.lit(base_us) + F.col("seq") * step_us)
    name = F.coalesce(F.nullif("image_id", F.lit("")), F.col("source_id"))
    return with_defaults(outputs).select("subject_id", us.alias("us"), "seq", *CLASSES, "uncertainty", name.alias("source_id"))


def derived(frames: DataFrame) -> DataFrame:
    """Confidence, dominant class (positive, neutral, negative on ties) and its probability."""
    return frames.withColumns({"confidence": 1 - F.col("uncertainty"), "dominant": argmax({c: F.col(c) for c in CLASSES}), "dominant_probability": F.greatest(*CLASSES)})


def windowed(frames: DataFrame, size_us: int) -> DataFrame:
    """``frames`` with ``window_index``: a window starts at the first frame at least ``size_us`` after the start of the
    one before."""

    def step(state, us):
        start, index = state
        if start is None or us - start >= size_us:
            start, index = us, index + 1
        return (start, index), (index,)

    return ordered_fold(frames, "subject_id", ["us", "seq"], ["us"], lambda: (None, -1), step, "window_index bigint")


def greedy_windows(frames: DataFrame, size_us: int) -> DataFrame:
    """``subject_id seq window_index``, see ``windowed``."""
    return windowed(frames.select("subject_id", "us", "seq"), size_us).select("subject_id", "seq", "window_index")


def weighted_probabilities(frames: DataFrame, *by: str) -> DataFrame:
    """Mean of each class weighted by confidence; no weight at all gives (0, 1, 0)."""
    w = 1 - F.col("uncertainty")
    total = F.sum(w)
    default = {"positive": 0.0, "neutral": 1.0, "negative": 0.0}
    return frames.groupBy(*by).agg(*(F.when(total > 0, F.sum(F.col(c) * w) / total).otherwise(default[c]).alias(c) for c in CLASSES))


def window_measures(frames: DataFrame) -> DataFrame:
    """A row per ``subject_id window_index`` of windowed frames: start, counts, weighted probabilities, their doubt, the
    longest run of each dominant class and the first three sources."""
    by = Window.partitionBy("subject_id", "window_index").orderBy("us", "seq")
    rows = derived(frames).withColumn("island", F.row_number().over(by) - F.row_number().over(Window.partitionBy("subject_id", "window_index", "dominant").orderBy("us", "seq")))
    runs = rows.groupBy("subject_id", "window_index", "dominant", "island").agg(F.count("*").alias("n"))
    runs = runs.groupBy("subject_id", "window_index").agg(*(F.coalesce(F.max(F.when(F.col("dominant") == c, F.col("n"))), F.lit(0)).alias(f"run_{c}") for c in CLASSES))
    named = rows.withColumn("nth", F.count(F.nullif("source_id", F.lit(""))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when((F.col("nth") <= 3) & (F.coalesce("source_id", F.lit("")) != ""), F.struct("nth", "source_id"))
    w, n = F.col("confidence"), F.count("*")
    share = {c: F.when(F.sum(w) > 0, F.sum(F.col(c) * w) / F.sum(w)).otherwise(1.0 if c == "neutral" else 0.0) for c in CLASSES}
    spread = F.sum(F.col("positive") * F.col("positive")) / n - 2 * share["positive"] * F.avg("positive") + share["positive"] * share["positive"]
    got = named.groupBy("subject_id", "window_index").agg(
        F.min("us").alias("us"), n.alias("frame_count"), F.avg(w).alias("avg_confidence"), *(v.alias(c) for c, v in share.items()),
        ((F.avg("uncertainty") > UNCERTAIN) | (n == 1) | (spread > SPREAD)).alias("doubtful"), F.avg(F.when(F.col("dominant") == "negative", F.col("negative"))).alias("led"),
        F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["source_id"]), ":").alias("source_id"),
    )
    return got.join(runs, ["subject_id", "window_index"])


def settled(measures: DataFrame) -> DataFrame:
    """The rules that look at one window: a floor for neutral where it is in doubt, and negative that persists."""
    p, n, m = (F.col(c) for c in CLASSES)
    lift = F.col("doubtful") & (n < LIFT) & (p + m > 0)
    scale = (p + m - (LIFT - n)) / (p + m)
    got = measures.withColumns({"positive": F.when(lift, p * scale).otherwise(p), "neutral": F.when(lift, LIFT).otherwise(n), "negative": F.when(lift, m * scale).otherwise(m)})
    lasting = (F.col("run_negative") >= RUN) & (m > NEGATIVE_LEAST) & (n > m)
    return got.withColumn("negative", F.when(lasting, F.greatest(m, NEGATIVE_SHARE * F.col("led"))).otherwise(m))


def no_escalation(before: tuple | None, *now: float) -> tuple[tuple, tuple]:
    """Probabilities after the rule that looks back: no class grows by more than ``STEP``, half of what is cut goes to
    neutral, and the sum is one again."""
    p = list(now)
    if before is not None:
        for i in range(3):
            over = p[i] - (before[i] + STEP)
            if over > 0:
                p[i] = before[i] + STEP
                p[1] = min(1.0, p[1] + over * 0.5)
        total = sum(p)
        p = [x / total for x in p] if total > 0 else p
    return tuple(p), tuple(p)


def frame_timeline(frames: DataFrame, size_us: int = int(WINDOW_S * 1e6)) -> DataFrame:
    """An event per window: ``subject_id window_index us label score positive neutral negative confidence frame_count
    source_id``, with the decided label, its probability, rounded values and the first three sources."""
    ready = settled(window_measures(windowed(frames, size_us)))
    kept = ready.select("subject_id", "window_index", "us", *(F.col(c).alias(f"{c}_0") for c in CLASSES), "run_positive", "run_negative", "avg_confidence", "frame_count", "source_id")
    got = ordered_fold(kept, "subject_id", ["window_index"], [f"{c}_0" for c in CLASSES], lambda: None, no_escalation, "positive double, neutral double, negative double")
    got = derived(got.withColumn("uncertainty", F.lit(0.0)))
    top = F.col("dominant")
    lasting = F.when(top == "positive", F.col("run_positive")).when(top == "negative", F.col("run_negative")) >= RUN
    label = F.when((F.col("dominant_probability") >= DECIDE) & ((top == "neutral") | lasting), top).otherwise("neutral")
    got = got.withColumn("label", label)
    score = F.when(F.col("label") == "positive", F.col("positive")).when(F.col("label") == "negative", F.col("negative")).otherwise(F.col("neutral"))
    return got.select("subject_id", "window_index", "us", "label", F.round(score, 4).alias("score"), *(F.round(c, 4).alias(c) for c in CLASSES), F.round("avg_confidence", 4).alias("confidence"), "frame_count", "source_id")


def flip_flops(events: DataFrame) -> DataFrame:
    """Windows whose label differs from equal neighbours on both sides: a diagnostic."""
    w = Window.partitionBy("subject_id").orderBy("window_index")
    return events.withColumn("flip_flop", F.coalesce((F.lag("label").over(w) == F.lead("label").over(w)) & (F.col("label") != F.lag("label").over(w)), F.lit(False)))


def compare_estimates(a: str, b: str) -> Column:
    """Absolute differences per class of two estimates given as structs, and whether any is above 0.01."""
    d = {c: F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in CLASSES}
    return F.struct(*(v.alias(c) for c, v in d.items()), (F.greatest(*d.values()) > 0.01).alias("different"))
