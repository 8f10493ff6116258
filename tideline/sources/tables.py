"""Tables in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session may lack one and gets a folder of this machine; a cluster
    may not, as its executors don't share such a folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's own tables. They are read lazily, so they stay until the application has ended;
    the folder can be deleted as a whole then."""
    return f"{shared_dir(spark)}/tideline-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again, so that its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
