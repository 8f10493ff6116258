"""A table that is appended to: ids without gaps, one commit at a time, and no batch twice.

``<path>/data/version=N`` holds the rows of an append, ``<path>/commits/version=N`` its one-row record: the batch it came
from, its first id and its number of rows. Readers take committed versions alone, so an append that fails leaves nothing
that is seen, and its number is used again. Rows are written once with the number of their task and their place in it;
ids are the counts of the tasks before, added on. One writer at a time: a second one finds the record of its version and
fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tideline.sources.tables import cut

COMMIT = "version long, batch string, first_id long, n_rows long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``version batch first_id n_rows`` of every append."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def append(spark: SparkSession, path: str, rows: DataFrame, batch: str | None = None) -> tuple[int, int]:
    """First and last id of the rows, which become visible as a whole. A ``batch`` that is there already changes nothing,
    and its ids are those it has; an empty one is recorded, too, and ends one before it begins."""
    done = commits(spark, path)
    if batch is not None:
        same = done.filter(F.col("batch") == batch).first()
        if same:
            return same["first_id"], same["first_id"] + same["n_rows"] - 1
    last = done.agg(F.coalesce(F.max("version"), F.lit(-1)).alias("version"), F.coalesce(F.max(F.col("first_id") + F.col("n_rows")), F.lit(1)).alias("next")).first()
    version, first = last["version"] + 1, last["next"]
    placed = cut(rows.withColumn("__place", F.monotonically_increasing_id()))
    task = F.shiftright("__place", 33)
    counts = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))  # a row per task of this append
    before = counts.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n") + first).alias("__first"))
    numbered = placed.withColumn("__task", task).join(F.broadcast(before), "__task")
    numbered = numbered.withColumn("id", F.col("__first") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__task", "__place", "__first")
    numbered.select("id", *rows.columns).write.mode("overwrite").parquet(f"{path}/data/version={version}")  # over what a failed append left
    n_rows = placed.count()
    spark.createDataFrame([(version, batch, first, n_rows)], COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/version={version}")
    return first, first + n_rows - 1


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed appends: ``id version`` and the columns of ``schema``."""
    versions = [r["version"] for r in commits(spark, path).select("version").collect()]  # a row per append
    kept = T.StructType([T.StructField("id", T.LongType()), *T._parse_datatype_string(schema).fields])
    if not versions:
        return spark.createDataFrame([], kept).withColumn("version", F.lit(None).cast("long"))
    found = spark.read.option("basePath", f"{path}/data").schema(T.StructType([*kept.fields, T.StructField("version", T.LongType())]))
    return found.parquet(*(f"{path}/data/version={v}" for v in sorted(versions)))


def sink(path: str, name: str, enrich: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch, enriched, is appended once, also if Spark hands it over again."""

    def write(rows: DataFrame, number: int) -> None:
        append(rows.sparkSession, path, enrich(rows) if enrich else rows, f"{name}:{number}")

    return write


#: Kinds of files that a post may have, and the lists of keywords of a user.
EXTENSIONS = ("png", "jpg", "jpeg", "gif")
KINDS = ("positive", "negative")


def checked_posts(rows: DataFrame) -> DataFrame:
    """Posts (``user_id image_path caption``) with ``problem``: the fields that are missing, or a kind of file that isn't
    taken; null where a post is fine."""
    fields = {"caption": F.col("caption"), "image": F.col("image_path"), "user_id": F.col("user_id").cast("string")}
    missing = F.array_join(F.filter(F.array(*(F.when(F.coalesce(c, F.lit("")) == "", name) for name, c in fields.items())), lambda m: m.isNotNull()), ", ")
    kind = F.when(F.contains("image_path", F.lit(".")), F.lower(F.substring_index("image_path", ".", -1)))
    wrong = F.when(~F.coalesce(kind.isin(*EXTENSIONS), F.lit(False)), "Unsupported file extension")
    return rows.withColumn("problem", F.when(missing != "", F.concat(F.lit("Missing required fields: "), missing)).otherwise(wrong))


def keyword_lists(pushes: DataFrame) -> DataFrame:
    """``user_id positive_keywords negative_keywords`` from pushed rows ``id user_id kind keyword``, in the order of their
    ids; a list that nothing was pushed to is empty."""
    entry = F.struct("id", "keyword")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))), lambda x: x["keyword"]).alias(f"{k}_keywords") for k in KINDS]
    return pushes.filter(F.col("kind").isin(*KINDS)).groupBy("user_id").agg(*lists)
