"""Checks of nested JSON documents of any depth: times, media paths and the entries of their arrays.

A document is opened level by level, each level as a table, until none has a container left. Keys and raw texts of a
level come from a string map, which keeps the order of the text, and their types from a VARIANT map beside it. A
document that is no JSON, or in which an object repeats a key, has no entries (``unreadable`` lists it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scalars import iso
from tideline.operators.integrity import LAST_SECOND, PATH_FIELDS, TIME_FIELDS, is_remote, issue
from tideline.sources.tables import cut

#: First and last second whose year has four digits.
FIRST_SECOND, END_SECOND = -62_135_596_800, 253_402_300_800
#: ISO 8601 of a date and, after it, a time down to the second or less, in its long and its short form.
LONG_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
SHORT_ISO = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def kind_of(value: Column) -> Column:
    """``object array string boolean null number`` of a VARIANT; null of none."""
    # The type's name is made once a value: in lambdas nothing is shared.
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    kinds = F.create_map(*(F.lit(x) for pair in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")) for x in pair))
    return F.coalesce(F.try_element_at(kinds, name), F.when(value.isNotNull(), "number"))


def walk(rows: DataFrame, key: str, document: str) -> DataFrame:
    """``key place path name member kind value timed``: every value below the root of each document.

    ``place`` are the positions down to it, so that it sorts in the order of the text; ``path`` reads like
    ``samples[3].meta.ts``. ``name`` is its key (``member``), or that of the array it stands in. ``value`` is the text of
    a scalar, or the JSON of a container. ``timed`` values lie inside a container that stands under a name of a time."""
    root = F.try_parse_json(document)
    now = rows.select(F.col(key), F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), kind_of(root).alias("kind"), F.col(document).alias("value"), F.lit(False).alias("timed"))
    found = None
    while True:
        below = F.col("timed") | (F.col("member") & F.lower("name").isin(*TIME_FIELDS)) if found is not None else F.col("timed")
        # Read once each, before the columns that take them twice.
        opened = now.filter("kind = 'object'").withColumns({"strings": F.from_json("value", "map<string,string>"), "variants": F.from_json("value", "map<string,variant>")})
        entries = F.arrays_zip(F.map_keys("strings").alias("k"), F.map_values("strings").alias("v"), F.transform(F.map_values("variants"), kind_of).alias("t"))
        objects = opened.select(key, "place", "path", below.alias("timed"), F.posexplode(entries).alias("i", "e"))
        objects = objects.select(
            key, F.concat("place", F.array("i")).alias("place"), F.when(F.col("path") == "", F.col("e.k")).otherwise(F.concat("path", F.lit("."), "e.k")).alias("path"),
            F.col("e.k").alias("name"), F.lit(True).alias("member"), F.col("e.t").alias("kind"), F.col("e.v").alias("value"), "timed",
        )
        strings, variants = F.from_json("value", "array<string>"), F.from_json("value", "array<variant>")
        entries = F.arrays_zip(strings.alias("v"), F.transform(variants, kind_of).alias("t"))
        arrays = now.filter("kind = 'array'").select(key, "place", "path", "name", below.alias("timed"), F.posexplode(entries).alias("i", "e"))
        arrays = arrays.select(
            key, F.concat("place", F.array("i")).alias("place"), F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"),
            "name", F.lit(False).alias("member"), F.col("e.t").alias("kind"), F.col("e.v").alias("value"), "timed",
        )
        now = cut(objects.unionByName(arrays))
        found = now if found is None else found.unionByName(now)
        if now.filter("kind IN ('object', 'array')").isEmpty():
            return found


def unreadable(rows: DataFrame, key: str, document: str) -> DataFrame:
    return rows.filter(F.try_parse_json(document).isNull()).select(key, *issue("ERROR", "json", F.lit("not readable as JSON"), F.lit("root")))


def instant(value: Column, kind: Column) -> Column:
    """Microseconds of an entry: ISO 8601 text (UTC unless it says otherwise), epoch seconds, or epoch milliseconds
    beyond the year 9999; true and false count as 1 and 0. Null where it is none of these."""

    def part(rx: str, *groups: int) -> Column:
        date = "-".join(["%s"] * len(groups[:-5]))
        hour, minute, second, fraction, zone = groups[-5:]
        get = lambda g, default: F.when(F.regexp_extract(value, rx, g) == "", default).otherwise(F.regexp_extract(value, rx, g))
        return F.format_string(f"{date}T%s:%s:%s.%s%s", *(F.regexp_extract(value, rx, g) for g in groups[:-5]), get(hour, "00"), get(minute, "00"), get(second, "00"), get(fraction, "0"), get(zone, "Z"))

    text = F.when(value.rlike(LONG_ISO), part(LONG_ISO, 1, 2, 3, 4, 5, 6)).when(value.rlike(SHORT_ISO), part(SHORT_ISO, 1, 2, 3, 4, 5, 6, 7, 8))
    seconds = F.when(kind == "boolean", F.when(value == "true", 1.0).otherwise(0.0)).otherwise(F.expr("try_cast(value AS double)"))
    seconds = F.when(seconds > LAST_SECOND, seconds / 1000).otherwise(seconds)
    number = F.when((seconds >= FIRST_SECOND) & (seconds < END_SECOND), F.round(seconds * 1_000_000).cast("long"))
    return F.when(kind == "string", F.unix_micros(F.try_to_timestamp(text))).when(kind.isin("number", "boolean"), number)


def times(walked: DataFrame, key: str) -> DataFrame:
    """``key place path value us parent index``: the entries that hold a time, and the array that they are ordered in:
    what stands before the first bracket of their path (``root`` without one) and the number in it."""
    named = walked.filter(F.col("member") & ~F.col("timed") & F.lower("name").isin(*TIME_FIELDS)).withColumn("us", instant(F.col("value"), F.col("kind"))).filter("us IS NOT NULL")
    parent = F.when(F.contains("path", F.lit("[")), F.substring_index("path", "[", 1)).otherwise("root")
    index = F.coalesce(F.regexp_extract("path", r"^[^\[]*\[(\d{1,18})\]", 1).try_cast("long"), F.lit(0))
    return named.select(key, "place", "path", "value", "us", parent.alias("parent"), index.alias("index"))


def shown(us: Column) -> Column:
    return F.concat(iso(us), F.lit("+00:00"))


def time_issues(walked: DataFrame, documents: DataFrame, key: str, as_of_us: int, strict: bool = False) -> DataFrame:
    """``key severity category message location``: documents without a time, times after ``as_of_us``, and times before
    the one in front of them in the same array (if strict, also equal ones). Times are shown in UTC."""
    found = times(walked, key)
    none = documents.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    none = none.select(key, *issue("WARNING", "temporal", F.lit("No timestamps found in data"), F.lit("root")))
    future = found.filter(F.col("us") > as_of_us).select(key, *issue("ERROR", "temporal", F.concat(F.lit("Future timestamp detected: "), shown(F.col("us"))), F.col("path")))
    order = Window.partitionBy(key, "parent").orderBy("index", "place")
    pairs = found.withColumns({"before": F.lag("us").over(order), "last": F.lag("path").over(order)})
    pairs = pairs.filter(F.col("us") <= F.col("before") if strict else F.col("us") < F.col("before"))
    said, sign = ("Non-strictly-monotonic timestamps: ", " <= ") if strict else ("Out-of-order timestamps: ", " < ")
    message = F.concat(F.lit(said), shown(F.col("us")), F.lit(sign), shown(F.col("before")))
    late = pairs.select(key, *issue("ERROR", "temporal", message, F.concat("path", F.lit(" (previous: "), "last", F.lit(")"))))
    return none.unionByName(future).unionByName(late)


def media_issues(walked: DataFrame, key: str, existing: DataFrame, base: str = "") -> DataFrame:
    """``key severity category message location``: text under a name of a medium that is empty, remote, missing from
    ``existing`` (``path is_file``, a row per path) or no file there. Relative paths are looked up below ``base``."""
    found = walked.filter(F.col("member") & (F.col("kind") == "string") & F.lower("name").isin(*PATH_FIELDS))
    plain = F.regexp_replace("value", r"^(\./+)+", "")
    full = F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit(f"{base.rstrip('/')}/" if base else ""), plain))
    local = (F.col("value") != "") & ~is_remote(F.col("value"))
    known = existing.select(F.col("path").alias("__known"), F.col("is_file").alias("__file"))
    got = found.withColumn("__full", F.when(local, full)).join(known, F.col("__full") == F.col("__known"), "left")
    severity = F.when(F.col("value") == "", "WARNING").when(~local, "INFO").when(F.col("__known").isNull() | ~F.col("__file"), "ERROR")
    message = (
        F.when(F.col("value") == "", "Empty media path").when(~local, "Skipping remote URL validation")
        .when(F.col("__known").isNull(), F.concat(F.lit("Media file not found: "), "value")).otherwise(F.concat(F.lit("Path exists but is not a file: "), "value"))
    )
    return got.withColumn("severity", severity).filter("severity IS NOT NULL").select(key, "severity", F.lit("path").alias("category"), message.alias("message"), F.col("path").alias("location"))


def report(documents: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """``key errors warnings infos valid`` of every document."""
    counts = issues.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(name) for s, name in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))))
    zero = {name: F.coalesce(name, F.lit(0)) for name in ("errors", "warnings", "infos")}
    return documents.select(key).distinct().join(counts, key, "left").withColumns(zero).withColumn("valid", F.col("errors") == 0)
