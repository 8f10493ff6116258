"""Checks of input data: times, order, paths and schemas, as rows of issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds beyond which a number is milliseconds.
LAST_SECOND = 253_402_300_800
ISSUE = ("severity", "category", "message", "location")


def parse_timestamp(value: Column) -> Column:
    """ISO text (``Z`` or an offset, UTC without), epoch seconds or epoch milliseconds; null if none."""
    n = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.cast("double"))
    iso = F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    return F.when(n.isNotNull() & (F.abs(n) > LAST_SECOND), F.timestamp_micros((n * 1000).cast("long"))).when(n.isNotNull(), F.timestamp_micros((n * 1_000_000).cast("long"))).otherwise(iso)


def issue(severity: str, category: str, message: Column, location: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), location.alias("location")]


def order_issues(rows: DataFrame, group: str, index: str, ts_us: str, strict: bool = False) -> DataFrame:
    """Entries of an array that come before (or, if strict, with) the one in front of them."""
    before = F.lag(ts_us).over(Window.partitionBy(group).orderBy(index))
    bad = F.col("__b") >= F.col(ts_us) if strict else F.col("__b") > F.col(ts_us)
    got = rows.withColumn("__b", before).filter(bad)
    return got.select(*issue("ERROR", "temporal", F.lit("out of order"), F.concat(F.col(group).cast("string"), F.lit("["), F.col(index).cast("string"), F.lit("]"))))


def future_issues(rows: DataFrame, ts_us: str, as_of_us: int, location: Column) -> DataFrame:
    return rows.filter(F.col(ts_us) > as_of_us).select(*issue("ERROR", "temporal", F.lit("timestamp in the future"), location))


#: Labels that a correction may give.
CORRECTIONS = ("Connectedness", "Hope", "Identity", "Meaning", "Empowerment", "None")


def user_id_ok(user: Column) -> Column:
    """Letters, digits, ``_ . - @`` of any script, 64 at most."""
    return F.coalesce(user.rlike(r"^[\p{L}\p{N}_.\-@]{1,64}$"), F.lit(False))


def correction_problem(post_id: Column, label: Column) -> Column:
    """Why a correction is refused; null if it is not."""
    return F.when((F.coalesce(post_id.cast("string"), F.lit("")) == "") | (F.coalesce(label, F.lit("")) == ""), "Missing data").when(~label.isin(*CORRECTIONS), "Invalid label")


def is_remote(path: Column) -> Column:
    return F.lower(path).rlike("^(https?|s3|ftp)://")


def path_issues(rows: DataFrame, path: str, existing: DataFrame, location: Column) -> DataFrame:
    """Empty paths warn, remote ones inform, local ones that ``existing`` (``path``) lacks are errors."""
    known = existing.select(F.col("path").alias("__known")).distinct()
    got = rows.join(known, F.col(path) == F.col("__known"), "left")
    empty = F.coalesce(F.trim(F.col(path)), F.lit("")) == ""
    severity = F.when(empty, "WARNING").when(is_remote(F.col(path)), "INFO").when(F.col("__known").isNull(), "ERROR")
    message = F.when(empty, "empty path").when(is_remote(F.col(path)), "remote path").otherwise("missing file")
    return got.withColumn("severity", severity).filter("severity IS NOT NULL").select("severity", F.lit("path").alias("category"), message.alias("message"), location.alias("location"))


@dataclass(frozen=True)
class Field:
    """A column of a schema: its name, whether it is required, what it must satisfy and the least size."""

    name: str
    required: bool = True
    pattern: str | None = None
    least: float | None = None


def schema_issues(rows: DataFrame, fields: list[Field], location: Column) -> DataFrame:
    """An issue per row and broken rule, in one pass."""
    found = []
    for f in fields:
        c = F.col(f.name)
        bad = []
        if f.required:
            bad.append(F.when(c.isNull(), f"{f.name} is required"))
        if f.pattern:
            bad.append(F.when(~c.cast("string").rlike(f.pattern), f"{f.name} has a wrong form"))
        if f.least is not None:
            bad.append(F.when(c < f.least, f"{f.name} is too small"))
        found += bad
    got = rows.select(F.explode(F.filter(F.array(*found), lambda m: m.isNotNull())).alias("m"), location.alias("l"))
    return got.select(*issue("ERROR", "schema", F.col("m"), F.col("l")))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")), F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)).alias("has_errors"))


#: Names of fields that hold times and media paths.
TIME_FIELDS = ("timestamp", "time", "datetime", "created_at", "recorded_at", "date", "ts", "event_time", "capture_time")
PATH_FIELDS = ("image", "audio", "video", "media", "image_path", "audio_path", "video_path", "file_path", "img", "sound", "recording")
