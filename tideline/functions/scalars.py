"""Column functions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ORDINAL = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session time is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def iso(us: Column) -> Column:
    """ISO 8601 of microseconds; the fraction is left out when it is zero."""
    ts = F.timestamp_micros(us)
    part = F.pmod(us, F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))))


def iso_sql(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END"


def ordinal(label: Column, unknown: str = "zero", case_sensitive: bool = False) -> Column:
    """positive 1, neutral 0, negative -1; another label is 0 or null, an empty one an error."""
    value = label if case_sensitive else F.lower(label)
    out = F.lit(None).cast("double") if unknown == "null" else F.when(label.isNotNull(), 0.0)
    for name, number in ORDINAL.items():
        out = F.when(value == name, number).otherwise(out)
    return F.when(label == "", F.raise_error(F.lit("empty emotion label"))).otherwise(out)


def ordinal_sql(label: str) -> str:
    return f"CASE lower({label}) WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


def round_up(value: Column, digits: int) -> Column:
    """``round`` of numbers of 0 and more, halves up, for rows by the billion: ``round`` makes a decimal of each."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def digest(text: Column, length: int = 32) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def seconds_text(us: Column) -> Column:
    """Seconds with six decimals, from whole microseconds."""
    rest = F.pmod(us, F.lit(1_000_000))
    return F.concat(((us - rest) / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two vectors given as columns; 0 when either is zero."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    norm = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((y * y for y in b), F.lit(0.0)))
    return F.when(norm == 0, 0.0).otherwise(dot / norm)


def argmax(named: dict[str, Column]) -> Column:
    """Name of the greatest value; the first one named wins a tie."""
    rows = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(named.items())]
    return F.array_max(F.array(*rows))["k"]
