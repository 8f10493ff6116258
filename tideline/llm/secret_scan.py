"""Secret scanning over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger has a row per blob and rule
version that was scanned, found or not; it is a Parquet folder that a scan reads and appends to. A scan takes each blob once, runs only the rule versions that the ledger
lacks for it, and joins the findings of all rules back to every path and version that has the blob. Only
built-in functions are used.

Copies of a text are united before they are sent (partial aggregation), and paths are joined back to findings by
blob and salt, so a blob that a third of all paths have is spread over ``SALTS`` tasks. Only blobs with findings
take part in that join.

Defined cases: a null text is an empty one; rows are kept as they are, with repeated rows and null ids; the
offsets are code points; an empty table gives an empty result; extra columns are ignored by the query and kept
by the stage. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm import spans as S
from tideline.llm.common import fresh, table, written

SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex`` whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base patterns. A run of hex digits or of an access key is maximal, so its least length can
#: stand in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 1, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9._%-]{1,64}:[^\x20\x09-\x0D/:@]{6,64}@"),
)
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """Ledger rows for the rule versions that ``ledger`` lacks for each of ``blobs`` (``blob text``)."""
    todo = blobs.withColumn("__done", F.array().cast("array<string>"))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("__done"))
        todo = blobs.join(done, "blob", "left").withColumn("__done", F.coalesce("__done", F.array().cast("array<string>")))

    def row(rule: Rule) -> Column:
        good = F.filter(S.matches(F.col("text"), rule.regex, rule.group), lambda s: F.length(s["value"]) >= rule.least)
        only = F.transform(F.coalesce(good, F.array().cast(S.SPAN)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when(~F.array_contains("__done", rule.key), F.struct(F.lit(rule.key).alias("rule"), only.alias("spans")))

    scanned = todo.select("blob", F.filter(F.array(*map(row, rules)), lambda x: x.isNotNull()).alias("__rows"))
    return scanned.select("blob", F.inline("__rows"))


def blobs_of(versions: DataFrame) -> DataFrame:
    """``versions`` (with ``blob``): each text once."""
    return versions.groupBy("blob").agg(F.first("text").alias("text"))


def addressed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def found_in(ledger: DataFrame, rules=RULES) -> DataFrame:
    """``blob, spans`` of blobs with findings: all spans of the current rule versions, by start and kind."""
    order = {r.key: (i, r.kind) for i, r in enumerate(rules)}
    which = F.create_map(*(x for k, (i, kind) in order.items() for x in (F.lit(k), F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind")))))
    rows = ledger.filter(F.size("spans") > 0).select("blob", which[F.col("rule")].alias("of"), F.explode("spans").alias("s")).filter("of IS NOT NULL")
    made = F.struct(F.col("s.start").alias("start"), F.col("of.ord").alias("ord"), F.col("s.end").alias("end"), F.col("of.kind").alias("kind"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set(made)).alias("spans"))  # a set: two scans at a time may both have a blob's rows


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def found_before(ledger: DataFrame, versions: DataFrame) -> DataFrame:
    return ledger.filter(F.size("spans") > 0).join(versions.select("blob"), "blob", "left_semi")


def scan(docs: DataFrame, ledger: DataFrame | str | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings to join to rows by blob and salt, rows that the ledger lacked). ``ledger`` is a table, or the path of
    a ledger: rows are appended there (by one scan at a time). Otherwise the new rows are written to the shared folder."""
    spark, path = docs.sparkSession, ledger if isinstance(ledger, str) else None
    if path:
        ledger = read_ledger(spark, path)
    versions = addressed(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    fresh = written(scan_unseen(blobs_of(versions), ledger, rules), "ledger")
    if path:
        fresh.write.mode("append").parquet(path)
    # Of an earlier ledger only rows with findings of these blobs are read on.
    known = fresh if ledger is None else found_before(ledger, versions).unionByName(fresh)
    found = found_in(known, rules)
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted, fresh


def salt_of(docs: DataFrame) -> Column:
    """By the row's id, so that a task that is run again deals its rows as before."""
    return F.pmod(F.xxhash64(F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)), F.lit(SALTS)).cast("int")


def with_spans(docs: DataFrame, salted: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with the findings of each row's text as ``name``, which replaces a column of that name."""
    docs = docs.drop(name)
    p = fresh(docs.columns)
    paths = docs.withColumns({f"{p}blob": F.sha2(F.coalesce("text", F.lit("")), 256), f"{p}salt": salt_of(docs)})
    found = salted.select(F.col("blob").alias(f"{p}blob"), F.col("__salt").alias(f"{p}salt"), F.col("spans").alias(name))
    got = paths.join(found.hint("shuffle_hash"), [f"{p}blob", f"{p}salt"], "left")
    return got.withColumn(name, F.coalesce(name, F.array().cast(S.KIND))).drop(f"{p}blob", f"{p}salt")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting ``tideline.secret.ledger`` names the ledger that runs share; without it this run has one of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    salted, _ = scan(docs, spark.conf.get("tideline.secret.ledger", None))
    # Only ids and addresses travel to the join.
    paths = addressed(docs).select("doc_id", "blob", salt_of(docs).alias("__salt"))
    got = paths.join(salted.hint("shuffle_hash"), ["blob", "__salt"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(S.KIND)))
    base = F.filter("spans", lambda s: s["ord"] < 3)
    return got.select("doc_id", *(S.how_many(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(S.written_out(base), 256).alias("base_sha256"), S.written_out(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts: each span becomes ``[secret]``."""
    salted, _ = scan(docs, spark.conf.get("tideline.secret.ledger", None))
    spans = f"{fresh(docs.columns)}spans"
    got = with_spans(docs, salted, spans)
    text = S.replaced(F.coalesce("text", F.lit("")), F.col(spans), lambda s: F.lit("[secret]"))
    got = got.withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    parts, rows = [], []
    for i, r in enumerate(RULES):
        parts.append(S.matches_sql(f"m{i}", "t", "doc_id", "text", quote(r.regex.replace("(?i:password|passwd|secret|token|api_?key)", KEYWORDS)), r.group))
        rows.append(f"SELECT doc_id, start, {i} AS ord, stop, '{r.kind}' AS kind FROM m{i} WHERE length(value) >= {r.least}")
    out = "kind || ':' || start || ':' || stop"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {', '.join(parts)}, allspans AS ({' UNION ALL '.join(rows)}),
agg AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS b, count(*) FILTER (WHERE ord = 2) AS c,
  string_agg({out}, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg({out}, ',' ORDER BY start, ord) AS spans FROM allspans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN agg USING (doc_id)"""


#: The keywords with either case spelt out, for engines whose case folding goes beyond ASCII.
KEYWORDS = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
QUERIES = {"op7_secret_scans": op7_secret_scans}
ORACLES = {"op7_secret_scans": _sql()}
