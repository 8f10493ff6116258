"""Recovery-dimension signatures of places, trajectories over visits, and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scalars import argmax, cosine
from tideline.operators.ordered import ordered_fold

DIMENSIONS = ("Connectedness", "Hope", "Identity", "Meaning", "Empowerment")


def place_signature(visits: DataFrame, by: tuple[str, ...] = ("place_type",)) -> DataFrame:
    """Mean of each dimension (a missing one counts 0), visit count, and volatility: the root of the mean variance."""
    value = {d: F.coalesce(F.col(d), F.lit(0.0)) for d in DIMENSIONS}
    got = visits.groupBy(*by).agg(F.count("*").alias("visit_count"), *(F.avg(v).alias(d) for d, v in value.items()), *(F.var_pop(v).alias(f"__{d}") for d, v in value.items()))
    return got.withColumn("volatility", F.sqrt(sum((F.col(f"__{d}") for d in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS))).drop(*(f"__{d}" for d in DIMENSIONS))


def chime_proximity(a: str, b: str, min_visits: int = 1) -> Column:
    """Cosine of two signatures given by column suffix; 0.5 when either has too few visits."""
    few = (F.col(f"visit_count{a}") < min_visits) | (F.col(f"visit_count{b}") < min_visits)
    return F.when(few, 0.5).otherwise(cosine([F.col(d + a) for d in DIMENSIONS], [F.col(d + b) for d in DIMENSIONS]))


def _sides(signatures: DataFrame, *block: str) -> DataFrame:
    a, b = (signatures.select(*block, *(F.col(c).alias(c + s) for c in ("place_type", "visit_count", *DIMENSIONS))) for s in ("_a", "_b"))
    return a.join(b, list(block)) if block else a.crossJoin(b)  # a row per place type: a handful


def cosine_matrix(signatures: DataFrame) -> DataFrame:
    """All ordered pairs of place types in long form; the diagonal is 1."""
    got = _sides(signatures)
    return got.select("place_type_a", "place_type_b", F.when(F.col("place_type_a") == F.col("place_type_b"), 1.0).otherwise(chime_proximity("_a", "_b")).alias("similarity"))


def proximate_pairs(signatures: DataFrame, threshold: float = 0.7) -> DataFrame:
    got = _sides(signatures).filter(F.col("place_type_a") < F.col("place_type_b")).withColumn("similarity", chime_proximity("_a", "_b"))
    return got.filter(F.col("similarity") >= threshold).select("place_type_a", "place_type_b", "similarity")


def recovery_anchors(signatures: DataFrame, dimensions=("Hope", "Connectedness"), threshold: float = 0.6, min_visits: int = 2) -> DataFrame:
    """Places whose best anchor dimension, damped by volatility, reaches the threshold."""
    score = F.greatest(*dimensions) * F.greatest(F.lit(0.0), 1 - F.col("volatility"))
    return signatures.withColumn("anchor_score", score).filter((F.col("visit_count") >= min_visits) & (F.col("anchor_score") >= threshold))


def dominant_dimension(named: dict[str, Column]) -> Column:
    return argmax(named)


def _moments(state: tuple, *values: float) -> tuple:
    """The next visit's running means and sums of products with the visit index; a product is added with one rounding."""
    n, x_mean, means, sums = state
    dx = n - x_mean
    n += 1
    means = [m + (v - m) / n for m, v in zip(means, values, strict=True)]
    sums = [math.fma(dx, v - m, s) for s, m, v in zip(sums, means, values, strict=True)]
    return (n, x_mean + dx / n, means, sums), (n, *sums)


def trajectories(visits: DataFrame, by: tuple[str, ...] = ("subject_id", "place_type")) -> DataFrame:
    """Slope of each dimension over the visit index, volatility and count; one visit has slope 0.

    Slopes that fall on a threshold or equal each other are told apart by their last bits, so the sums are folded in the
    order of the visits, which no aggregate promises, and rounded as the SQL's are."""
    zeros = [0.0] * len(DIMENSIONS)
    rows = visits.select(F.struct(*by).alias("__by"), "us", "seq", *(F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias(d) for d in DIMENSIONS))
    out = "n long, " + ", ".join(f"s{i} double" for i in range(len(DIMENSIONS)))
    folded = ordered_fold(rows, "__by", ["us", "seq"], list(DIMENSIONS), lambda: (0, 0.0, zeros, zeros), _moments, out)
    last = F.max_by(F.struct(*(f"s{i}" for i in range(len(DIMENSIONS)))), "n")
    got = folded.groupBy("__by").agg(F.count("*").alias("visit_count"), last.alias("__s"), F.var_pop(F.col("n") - 1).alias("__x"), *(F.var_pop(d).alias(f"__{d}") for d in DIMENSIONS))
    slope = lambda i: F.when(F.col("visit_count") > 1, F.col(f"__s.s{i}") / F.col("visit_count") / F.col("__x")).otherwise(0.0)
    volatility = F.sqrt(sum((F.col(f"__{d}") for d in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS))
    return got.select(*(F.col(f"__by.{c}").alias(c) for c in by), "visit_count", *(slope(i).alias(d) for i, d in enumerate(DIMENSIONS)), volatility.alias("volatility"))


def recovery_correlations(trend: DataFrame, dimensions=DIMENSIONS, min_visits: int = 2, least: float = 0.01, by: tuple[str, ...] = ("subject_id", "place_type")) -> DataFrame:
    """A row per place and dimension whose slope is above ``least``."""
    rows = trend.filter(F.col("visit_count") >= min_visits).unpivot([*by, "visit_count"], list(dimensions), "dimension", "slope")
    return rows.filter(F.col("slope") > least)


def trajectory_summary(trend: DataFrame, least: float = 0.01) -> DataFrame:
    """Dominant dimension by absolute slope and whether it is improving, declining or stable."""
    got = trend.withColumn("dominant", argmax({d: F.abs(F.col(d)) for d in DIMENSIONS}))
    slope = F.coalesce(*(F.when(F.col("dominant") == d, F.col(d)) for d in DIMENSIONS))
    return got.withColumn("slope", slope).withColumn("direction", F.when(F.col("slope") > least, "improving").when(F.col("slope") < -least, "declining").otherwise("stable"))


def location_profile(entries: DataFrame) -> DataFrame:
    """Count, mean, population deviation, counts per sentiment and the dominant one (first named on ties)."""
    kinds = ("positive", "neutral", "negative")
    got = entries.groupBy("location_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), *(F.count_if(F.col("sentiment") == k).alias(k) for k in kinds))
    return got.withColumn("dominant", argmax({k: F.col(k) for k in kinds}))


def hotspots(profile: DataFrame, share: float = 0.6, visits: int = 3) -> DataFrame:
    most = F.greatest("positive", "neutral", "negative")
    return profile.filter((F.col("n") >= visits) & (most / F.col("n") >= share)).select("location_id", "dominant", "n", (most / F.col("n")).alias("share"))


def type_comparison(entries: DataFrame, types: DataFrame) -> DataFrame:
    """Shares of sentiments and score moments by place type (``location_id type``)."""
    got = entries.join(types, "location_id").groupBy("type").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("variance"), *((F.count_if(F.col("sentiment") == k) * 100 / F.count("*")).alias(f"{k}_pct") for k in ("positive", "neutral", "negative")))
    return got


def welch_t(moments: DataFrame) -> DataFrame:
    """Welch's t of every pair of types from their moments (a row per type: a handful)."""
    a, b = (moments.select(F.col("type").alias(f"type_{s}"), F.col("n").alias(f"n_{s}"), F.col("mean").alias(f"m_{s}"), F.col("variance").alias(f"v_{s}")) for s in "ab")
    got = a.crossJoin(b).filter("type_a < type_b")
    return got.select("type_a", "type_b", ((F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))).alias("t"))


MONTH_US = 30 * 86_400_000_000


def location_trend(entries: DataFrame, least: float = 0.1) -> DataFrame:
    """Slope of the score per 30 days since the first visit, and its direction."""
    first = F.min("us").over(Window.partitionBy("location_id"))
    rows = entries.withColumn("t", (F.col("us") - first) / float(MONTH_US))
    got = rows.groupBy("location_id").agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("score", "t"), F.lit(0.0)).alias("slope"))
    return got.withColumn("direction", F.when(F.col("slope") >= least, "improving").when(F.col("slope") <= -least, "declining").otherwise("stable"))


def anova_f(entries: DataFrame, types: DataFrame) -> DataFrame:
    """One-way F of the score by place type, from sums of squares of group moments."""
    g = entries.join(types, "location_id").groupBy("type").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"))
    between = F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")
    return s.select((between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence of two categorical columns."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    grid = ra.crossJoin(rb).join(cells, [a, b], "left").crossJoin(F.broadcast(cells.agg(F.sum("o").alias("n"))))
    e = F.col("ra") * F.col("rb") / F.col("n")
    return grid.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, F.lit(2)) / e).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))


def add_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (``location_id us seq sentiment score``) with new ones appended; an entry without a place or with a score
    outside of 0 to 1 is an error."""
    ok = F.col("location_id").isNotNull() & F.col("score").between(0, 1)
    checked = new.withColumn("location_id", F.when(F.coalesce(ok, F.lit(False)), F.col("location_id")).otherwise(F.raise_error(F.lit("no place, or a score outside of 0 to 1"))))
    return entries.unionByName(checked.select(*entries.columns))
