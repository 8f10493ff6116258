"""Labels, splits and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def label_fractions(rows: DataFrame, *by: str) -> DataFrame:
    got = rows.groupBy(*by).agg(F.count("*").alias("n"))
    outer = Window.partitionBy(*by[:-1]) if len(by) > 1 else None
    if outer is not None:
        return got.withColumn("fraction", F.col("n") / F.sum("n").over(outer))
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("__all")))).withColumn("fraction", F.col("n") / F.col("__all")).drop("__all")


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, weighted precision and recall from a confusion matrix.

    A class that is never predicted, or never occurs, has precision, or recall, 0."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("s"))
    per = sides.groupBy("s.c").agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"))
    hit = matrix.filter("label = predicted").groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("hit"))
    per = per.join(hit, "c", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"p": p, "r": r}).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f").alias("macro_f1"), mean("f").alias("weighted_f1"), mean("p").alias("precision"), mean("r").alias("recall"))


def sweep_summary(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Count, mean and sample deviation of each metric per setting, the best first."""
    got = runs.groupBy(*by).agg(F.count("*").alias("runs"), *(F.avg(m).alias(f"{m}_mean") for m in metrics), *(F.stddev_samp(m).alias(f"{m}_std") for m in metrics))
    return got.orderBy(*(F.desc(f"{m}_mean") for m in metrics))


def stability(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric mean std`` over runs of different seeds: the sample deviation, null for one run."""
    means = runs.agg(*(F.struct(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std")).alias(m) for m in metrics))
    return means.unpivot([], metrics, "metric", "v").select("metric", "v.mean", "v.std")


def parameter_grid(spark, most: int = 50, **values: list) -> DataFrame:
    """All combinations of literal lists; more than ``most`` is an error."""
    total = 1
    for v in values.values():
        total *= len(v)
    if total > most:
        raise ValueError(f"{total} combinations; at most {most} are allowed")
    frames = [spark.createDataFrame([(x,) for x in v], [k]) for k, v in values.items()]
    got = frames[0]
    for other in frames[1:]:
        got = got.crossJoin(other)
    return got


def grouped_split(rows: DataFrame, group: Column, seed: int = 42, train: int = 80, validation: int = 10) -> DataFrame:
    """``split`` by a hash of the group: the rows of a group stay together, and a rerun gives the same."""
    u = F.pmod(F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), group.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(100))
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def stratified_group_split(rows: DataFrame, group: str, label: str, shares: tuple[tuple[str, int], ...] = (("train", 80), ("validation", 10), ("test", 10)), seed: int = 42) -> DataFrame:
    """``split`` for each row: groups stay whole, and each label gets its share of every split.

    A group counts for its most frequent label (the first by name on ties; a null group is one, a null label the last).
    The groups of a label stand one after the other in the order of a seeded digest, and each goes to the split that holds
    its middle: every split is off by less than a group at each of its two ends. The order is dealt to tasks by the
    digest's first digits and shifted by their sums."""
    p = "__"
    key = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    counts = rows.groupBy(key.alias(f"{p}g"), F.col(label).alias(f"{p}l")).agg(F.count("*").alias(f"{p}n"))
    best = F.min_by(F.struct(f"{p}l"), F.struct(-F.col(f"{p}n"), F.col(f"{p}l").isNull(), f"{p}l"))[f"{p}l"]
    groups = counts.groupBy(f"{p}g").agg(best.alias(f"{p}l"), F.sum(f"{p}n").alias(f"{p}n"))
    groups = groups.withColumn(f"{p}h", F.md5(F.concat(F.lit(f"{seed}:"), f"{p}g").cast("binary"))).withColumns({f"{p}d": F.substring(f"{p}h", 1, 3), f"{p}l": F.to_json(F.struct(f"{p}l"))})
    sums = groups.groupBy(f"{p}l", f"{p}d").agg(F.sum(f"{p}n").alias(f"{p}s"))
    ordered = Window.partitionBy(f"{p}l").orderBy(f"{p}d")  # 4096 rows at most
    sums = sums.withColumns({f"{p}b": F.sum(f"{p}s").over(ordered) - F.col(f"{p}s"), f"{p}t": F.sum(f"{p}s").over(Window.partitionBy(f"{p}l"))}).drop(f"{p}s")
    local = F.sum(f"{p}n").over(Window.partitionBy(f"{p}l", f"{p}d").orderBy(f"{p}h", f"{p}g").rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{p}n")
    placed = groups.withColumn(f"{p}a", local).join(sums, [f"{p}l", f"{p}d"])
    middle, whole = 2 * (F.col(f"{p}b") + F.col(f"{p}a")) + F.col(f"{p}n"), sum(n for _, n in shares)
    split, end = None, 0
    for name, n in shares:
        end += n
        inside = middle * whole < 2 * end * F.col(f"{p}t")
        split = F.when(inside, name) if split is None else split.when(inside, name)
    chosen = placed.select(f"{p}g", split.otherwise(shares[-1][0]).alias("split"))
    return rows.withColumn(f"{p}g", key).join(chosen, f"{p}g").drop(f"{p}g")


def split_leakage(rows: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """Ids from 0 in the order of the labels (a row per label, then joined)."""
    names = rows.select(label).distinct()
    ids = names.alias("a").join(names.alias("b"), F.col(f"b.{label}") < F.col(f"a.{label}"), "left").groupBy(F.col(f"a.{label}").alias(label)).agg(F.count(F.col(f"b.{label}")).alias("label_id"))
    return rows.join(F.broadcast(ids), label)


def learning_curves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation series of a log by which loss a row has."""
    return log.filter("loss IS NOT NULL AND eval_loss IS NULL").select("step", "loss"), log.filter("eval_loss IS NOT NULL").select("step", "eval_loss")


def kept_runs(runs: DataFrame, newest: int) -> DataFrame:
    """Whether a run folder is kept: sweeps go first, then all but the newest by name."""
    ranked = runs.withColumn("__r", F.row_number().over(Window.partitionBy(F.col("name").startswith("sweep")).orderBy(F.desc("name"))))
    return ranked.withColumn("keep", ~F.col("name").startswith("sweep") & (F.col("__r") <= newest)).drop("__r")
