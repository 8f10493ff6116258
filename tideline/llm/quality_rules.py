"""Rule-based quality filter: a threshold table compiled into one Spark projection.

``measure`` adds the statistics, ``compile_rules`` turns the threshold table into boolean columns and
``quality_rules`` does both. Only built-in functions are used and nothing is shuffled, so the cost is one
pass over the text and no key can be hot.

Defined cases: a null or blank text has no words and fails the base rules; rows are judged one by one, so
repeated rows and null ids are kept as they are and columns of the input other than the measured ones pass
through; an input column with the name of an output column is replaced. A text of any length is measured
whole. Windows of words are compared by a chained 64-bit hash, within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm.common import SPACE, fresh, table, words

WINDOW = 8
#: Frequent function words of the four languages.
STOP_WORDS = (
    "a", "al", "als", "an", "and", "are", "at", "au", "auf", "avec", "be", "by", "con", "dans", "das", "de", "del", "dem", "den", "der",
    "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from", "für", "he", "im", "in", "is", "ist", "it", "la",
    "las", "le", "les", "lo", "los", "mit", "ne", "nicht", "no", "of", "on", "par", "para", "pas", "por", "pour", "que", "qui", "se",
    "sich", "su", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu",
)


@dataclass(frozen=True)
class Rule:
    """A text fails when ``scale * numerator`` is beyond ``bound * denominator`` (``side`` is '<' or '>')."""

    name: str
    numerator: str
    side: str
    bound: int
    denominator: str | None = None
    scale: int = 1
    base: bool = False


#: The threshold table. Ratios are in whole hundredths, so both sides of a comparison are exact integers.
RULES = (
    Rule("too_few_words", "n_words", "<", 20, base=True),
    Rule("repeated_windows", "n_repeat_words", ">", 30, "n_words", 100, base=True),
    Rule("short_words", "word_chars", "<", 200, "n_words", 100),
    Rule("long_words", "word_chars", ">", 1500, "n_words", 100),
    Rule("symbols", "n_symbols", ">", 15, "n_words", 100),
    Rule("exclamations", "n_bangs", ">", 30, "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines", 100),
    Rule("no_stop_words", "n_stop_words", "<", 2, "n_words", 100),
)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words word_chars n_symbols n_bangs n_lines n_dup_lines n_stop_words n_repeat_words`` (long)."""
    keep = [c for c in docs.columns if c not in MEASURES]
    p = fresh(keep)
    w, lines, hashes, windows, order, places = (p + x for x in ("w", "lines", "wh", "h", "s", "p"))
    text = F.coalesce(F.col(f"{p}text"), F.lit(""))
    got = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias(f"{p}text"))
    got = got.withColumns({w: words(text), lines: F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))})
    got = got.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count_of(text, "#*$%&|<>"),
        "n_bangs": _count_of(text, "!"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        hashes: F.transform(w, lambda x: F.xxhash64(x)),
    })
    got = got.withColumn(windows, F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))))
    # Most texts repeat no window: only the others pay for sorting.
    got = got.withColumn(order, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(order, lambda s, k: F.coalesce(F.get(order, k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(order, k + 1)["h"] == s["h"], F.lit(False)))
    got = got.withColumn(places, F.when(F.col(order).isNotNull(), F.sort_array(F.transform(twice, lambda s: s["i"]))))
    covered = F.aggregate(F.transform(places, lambda i, k: F.least(F.coalesce(F.get(places, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    got = got.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return got.select(*(F.col(f"`{c}`") for c in keep), *MEASURES)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def compile_rules(rules=RULES) -> dict[str, Column]:
    """A boolean column per rule, true where a text fails it."""
    out = {}
    for rule in rules:
        left = F.col(rule.numerator) * rule.scale
        right = F.lit(rule.bound).cast("long") * (F.col(rule.denominator) if rule.denominator else 1)
        out[rule.name] = (left < right) if rule.side == "<" else (left > right)
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed`` (names of failed rules) and ``kept``."""
    failed = compile_rules(rules)
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | failed[rule.name]
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in failed.items())), lambda x: x.isNotNull())
    got = measure(docs.drop("base_failed", "failed", "kept"), text_col)
    return got.withColumns({"base_failed": base, "failed": names}).withColumn("kept", F.size("failed") == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with the columns they came with."""
    p = fresh(docs.columns)
    held = {c: f"{p}{c}" for c in docs.columns if c in (*MEASURES, "base_failed", "failed", "kept")}
    # A filter on a column is pushed below the projection by copying the column's expressions, measures of
    # measures over and over; the always true term is not deterministic, which keeps the filter above.
    judged = quality_rules(docs.withColumnsRenamed(held)).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).filter("kept")
    return judged.select(*(F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns))


def measures_sql(docs: str) -> str:
    """CTEs ending in ``measured`` (one row per row of ``docs``), for the SQL check; ``doc_id`` is unique there."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
w0 AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w1 AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w0),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w1 WHERE len(w) >= {WINDOW}),
wtx AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wtx) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM dup) GROUP BY doc_id),
measured AS (SELECT w1.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w1 LEFT JOIN rep USING (doc_id))"""


def failed_sql(rules=RULES) -> tuple[str, str]:
    """SQL conditions: a base rule fails; any rule fails."""
    one = lambda r: f"{r.scale} * {r.numerator} {r.side} {r.bound} * {r.denominator or 1}"
    return " OR ".join(one(r) for r in rules if r.base), " OR ".join(one(r) for r in rules)


BASE_SQL, ANY_SQL = failed_sql()
SQL = f"""WITH {measures_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_SQL}) AS base_failed, NOT ({ANY_SQL}) AS kept FROM measured"""
QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": SQL}
