"""Places of regular-expression matches as native arrays.

Spark has no function for the offsets of matches, but the pieces between the matches (``split``) and the
matches (``regexp_extract_all``) come from the same scan, so offsets are running sums of their lengths. The time
is in proportion to the text and its matches: no fold copies a long array, and no place is sought from the start.
Offsets are code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,text:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a fold copies at most: running values are made within parts, and parts of parts, of so many.
PART = 64


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each element of an array of integers the ``join`` (sum, greatest) of 0 and the elements before it. A fold that
    appends copies its array each time, so arrays are cut into parts whose starts are found in the same way."""

    def within(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(part, zero, step, lambda s: s["out"])

    if levels == 1:
        return within(values, F.lit(0))
    def cut(values: Column) -> Column:
        count = F.ceil(F.size(values) / PART).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * PART + 1, F.lit(PART)))
        return F.when(count > 0, let(parts, placed)).otherwise(F.array().cast("array<int>"))

    def placed(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), join))
        return let(running(whole, join, levels - 1), lambda starts: F.flatten(F.transform(parts, lambda p, i: within(p, F.get(starts, i)))))

    return let(values, cut)


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, text, value); null where there is none.
    ``value`` is the group asked for. Texts without a match are scanned once and cost no arrays."""
    rx = F.lit(regex)
    found, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, regex, -1)
    values = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
    rows = F.filter(F.arrays_zip(found.alias("text"), gaps.alias("gap"), values.alias("value")), lambda r: r["text"].isNotNull())

    def placed(rows: Column) -> Column:
        steps = F.transform(rows, lambda r: F.length(r["gap"]) + F.length(r["text"]))

        def span(r: Column, before: Column) -> Column:
            start = before + F.length(r["gap"])
            return F.struct(start.alias("start"), (start + F.length(r["text"])).alias("end"), r["text"].alias("text"), r["value"].alias("value"))

        return let(running(steps, lambda a, b: a + b), lambda before: F.transform(rows, lambda r, i: span(r, F.get(before, i))))

    return F.when(F.regexp_like(text, rx), let(rows, placed))


#: Code points of a chunk of a text: a place is found within its chunk and not by counting from the start.
CHUNK = 256


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def taken(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text with these ``chunks``."""
    first, size = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int") - F.floor(start / CHUNK).cast("int") + 1
    return F.when(end > start, F.substr(F.array_join(F.slice(pieces, first + 1, size), ""), start - first * CHUNK + 1, end - start)).otherwise("")


def kinds(found: dict[str, tuple[Column, Callable[[Column], Column]]]) -> Column:
    """Spans of several kinds as structs (start, order of the kind, end, kind), by start and kind; each kind
    has its matches and the test that a match must pass."""

    def made(order: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [F.coalesce(made(i, kind, F.filter(spans, test)), F.array().cast(KIND)) for i, (kind, (spans, test)) in enumerate(found.items())]
    return F.sort_array(F.concat(*parts))


KIND = "array<struct<start:int,ord:int,end:int,kind:string>>"


def written_out(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def how_many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced; what spans share is replaced once, by the mark of the first."""
    ends = F.transform(spans, lambda s: s["end"])

    def said(before: Column, pieces: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.get(before, i)
            return F.when(s["start"] >= at, F.concat(taken(pieces, at, s["start"]), mark(s))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, one), ""), F.substr(text, F.array_max(ends) + 1))

    done = let(running(ends, lambda a, b: F.greatest(a, b)), lambda before: let(chunks(text), lambda pieces: said(before, pieces)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def matches_sql(name: str, source: str, key: str, text: str, regex: str, group: int = 0) -> str:
    """A CTE ``name`` with a row per match: key, start, end, text, value (for the SQL check)."""
    return f"""{name}_0 AS (SELECT {key}, regexp_extract_all({text}, '{regex}', 0) AS m, regexp_extract_all({text}, '{regex}', {group}) AS v, string_split_regex({text}, '{regex}') AS g FROM {source} WHERE regexp_matches({text}, '{regex}')),
{name}_1 AS (SELECT {key}, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_0),
{name} AS (SELECT {key}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS stop, m[i] AS text, v[i] AS value FROM {name}_1)"""
