"""Data sets of faces and of labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The classes of each data set, in the order of their ids.
CLASSES = {
    "fer2013": ("angry", "disgust", "fear", "happy", "sad", "surprise", "neutral"),
    "imdb": ("woman", "man"),
    "KDEF": ("AN", "DI", "AF", "HA", "SA", "SU", "NE"),
}
#: The score that a face must be above.
FACE_SCORE = 3
#: Never inside a line: lines are read as one column.
NO_SEPARATOR = "\x01\x02\x03"


def _classes(name: str) -> tuple[str, ...]:
    if name not in CLASSES:
        raise ValueError(f"not a data set: {name}")
    return CLASSES[name]


def class_id(name: str, label: Column) -> Column:
    """The id of a class; null for another label."""
    at = F.array_position(F.array(*map(F.lit, _classes(name))), label)
    return F.when(at > 0, (at - 1).cast("int"))


def class_name(name: str, number: Column) -> Column:
    """The class of an id; null for another number."""
    return F.get(F.array(*map(F.lit, _classes(name))), F.when(number >= 0, number.cast("int")).otherwise(-1))


def one_hot(name: str, number: Column) -> Column:
    """Zeros, but for the class; zeros alone without a class."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(_classes(name)) - 1)), lambda i: F.coalesce((i == number).cast("int"), F.lit(0)))


def imdb_faces(rows: DataFrame) -> DataFrame:
    """``full_path gender label`` of pictures (``position full_path gender face_score second_face_score``) with one good
    face of known gender; the last row of a path counts. Missing scores are null or not a number."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    kept = rows.filter(known("face_score") & (F.col("face_score") > FACE_SCORE) & ~known("second_face_score") & known("gender"))
    last = kept.groupBy("full_path").agg(F.max_by(F.col("gender").cast("int"), "position").alias("gender"))
    return last.withColumn("label", class_name("imdb", F.col("gender")))


def kdef_files(spark: SparkSession, root: str) -> DataFrame:
    """``path code emotion classes`` of the ``.jpg`` files below ``root``: characters 5 and 6 of a name are its code. A
    file with another code stays, without a class. Pictures are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").filter(F.lower("path").endswith(".jpg"))
    named = files.withColumn("code", F.substring(F.substring_index("path", "/", -1), 5, 2)).withColumn("emotion", class_id("KDEF", F.col("code")))
    return named.withColumn("classes", one_hot("KDEF", F.col("emotion")))


def last_comma_rows(spark: SparkSession, path: str) -> DataFrame:
    """``text label malformed`` of lines below a header, cut at their last comma; a line without one is malformed and has
    neither. Text loses the quotes around it, and doubled ones inside of those. Blank lines are left out. The header is
    that of each file."""
    lines = spark.read.option("header", True).option("sep", NO_SEPARATOR).option("quote", "\0").option("escape", "\0").schema("value string").option("enforceSchema", True).csv(path)
    lines = lines.filter(F.trim("value") != "")
    whole = F.contains("value", F.lit(","))
    label = F.substring_index("value", ",", -1)
    text = F.trim(F.substring(F.col("value"), F.lit(1), F.length("value") - F.length(label) - 1))
    inside = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
    bare = F.when((F.length(text) >= 2) & text.startswith('"') & text.endswith('"'), inside).otherwise(text)
    return lines.select(F.when(whole, bare).alias("text"), F.when(whole, F.trim(label)).alias("label"), (~whole).alias("malformed"))


def label_name(spark: SparkSession, path: str) -> str:
    """What the header calls its last column, if it has more than one."""
    names = [n.strip() for n in spark.read.option("header", True).option("sep", NO_SEPARATOR).csv(path).columns[0].split(",") if n.strip()]
    return names[-1] if len(names) > 1 else "label"
