"""Files: posts from CSV and JSON, media folders, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REQUIRED = ("user_id", "image_path", "caption")


def posts_from_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, rejected lines) of a CSV with a header. ``timestamp`` is optional; missing columns are an error."""
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in REQUIRED if c not in header]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", __bad string"
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("multiLine", True).schema(schema).csv(path)
    full = F.lit(True)
    for c in REQUIRED:
        full = full & (F.coalesce(F.trim(c), F.lit("")) != "")
    ok = full & F.col("__bad").isNull()
    ts = F.try_to_timestamp("timestamp") if "timestamp" in header else F.lit(None).cast("timestamp")
    marked = rows.withColumn("__ok", ok)
    return marked.filter("__ok").select(*REQUIRED, ts.alias("ts")), marked.filter("NOT __ok").select(*header)


def photo_list(spark: SparkSession, path: str) -> DataFrame:
    """A row per photo of JSON files ``{subject, photos: [{filename, category, description}]}``."""
    kind = "subject string, photos array<struct<filename:string,category:string,description:string>>"
    return spark.read.option("multiLine", True).schema(kind).json(path).select("subject", F.inline("photos"))


def json_with_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects of files that may have other text behind the closing brace."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json(F.regexp_extract("value", r"(?s)^.*\}", 0), schema).alias("j")).select("j.*")


def sample_files(spark: SparkSession, root: str) -> DataFrame:
    """The text, image and audio of each ``person/sample`` folder: a transcript before the first clip."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split("path", "/")
    rows = files.select("path", F.element_at(parts, -3).alias("person"), F.element_at(parts, -2).alias("sample"), F.element_at(parts, -1).alias("name"))
    rank = F.when(F.col("name").startswith("transcript"), 0).when(F.col("name").startswith("clip"), 1)
    first = lambda flag: F.min(F.when(flag, F.col("path")))
    return rows.groupBy("person", "sample").agg(
        F.min_by("path", F.when(rank.isNotNull() & F.col("name").endswith(".txt"), F.struct(rank, "path"))).alias("text"),
        first(F.col("name").startswith("description")).alias("description"),
        first(F.col("name").rlike(r"\.(jpg|jpeg|png)$")).alias("image"), first(F.col("name").rlike(r"\.(wav|mp3)$")).alias("audio"),
    )


def pixels(rows: DataFrame) -> DataFrame:
    """Space-separated pixel values as an array of integers."""
    return rows.withColumn("pixels", F.transform(F.split("pixels", " "), lambda x: x.cast("int")))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Files with their digest and whether it is the expected one."""
    got = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return got.withColumn("ok", F.col("sha256") == sha256)


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)
