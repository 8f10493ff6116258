"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.sources.tables import scratch

#: Regular-expression class of the characters that separate words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read that table."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the number of buckets of our own exchanges follows it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str]) -> str:
    """A prefix that none of ``columns`` starts with, for columns of our own beside them."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def words(text: Column) -> Column:
    """Words of a text in order (an empty array for null), separated by ASCII white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
