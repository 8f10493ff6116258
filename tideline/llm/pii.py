"""Personal data: pattern rules, and terms that give protected entities away.

Rules find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Information-theoretic part: an
entity is a value that a rule found, of any frequency. Over the whole corpus, ``co`` counts the documents that hold a
term and an entity, ``df`` those that hold the term, and ``share`` is the part of the corpus that holds the entity.
The rate ``(co + SMOOTH * share) / (df + SMOOTH)`` is the chance of the entity given the term, smoothed by ``SMOOTH``
documents that have the entity as often as the corpus has. A term discloses an entity when its rate is at least
``DISCLOSURE`` hundredths and tells at least ``BITS`` bits more than ``share`` does. A term that discloses any entity
is a span of kind ``term`` at each of its places in every document, unless an entity overlaps it. ``op10_pii`` returns
these spans; ``sanitise`` replaces entities by their kind and generalises terms to ``[term]``.

``op10_pii_context`` is a narrower view beside it: a term counts only within ``CONTEXT`` characters of an entity, with
no smoothing but a ``SUPPORT`` of documents, and is a span only near that entity. Only built-in functions are used.

Frequencies of terms are counted over all documents with partial sums before they are joined. Terms (and entities)
that stand in the same documents have the same counts, so one of each such class stands for all of it: a document
makes a row per class of terms and class of entities that could disclose each other, not per pair of values.

Defined cases: a null text is empty; rows of one id with different texts are judged by text; repeated rows get the
same spans and count as often as they stand in all counts; null ids are kept; offsets are code points; an empty
table gives an empty result; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideline.llm import spans as S
from tideline.llm.common import fresh, table, written

CONTEXT, TERM_CHARS = 60, 4
SUPPORT, DISCLOSURE, BITS = 5, 50, 4.0
#: Documents that ``disclosures`` adds to those of a term, with the entity in the corpus's share of them.
SMOOTH = 1
#: Terms up to which the list of those in question is broadcast (counted first).
BROADCAST_TERMS = 200_000
#: Documents (two numbers each) up to which those without entities but with such a term are broadcast (counted first).
BROADCAST_DOCUMENTS = 500_000
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match can only start where its run starts or where a match ended, which is
#: said so that a long run is tried once; possessive parts can't be given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A single separator between digits is marked first, so that a chain of digits is one run of two classes.
LINK = ""
CARD = f"[0-9][0-9{LINK}]*[0-9]"


def chained(text: Column) -> Column:
    free = F.when(F.contains(text, F.lit(LINK)), F.replace(text, F.lit(LINK), F.lit(""))).otherwise(text)
    return F.regexp_replace(free, r"(?<=[0-9])[\x20-](?=[0-9])", LINK)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def at(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), at), F.lit(0), lambda a, x: a + x) % 10 == 0


def entities(text: Column) -> Column:
    """All base matches as structs (start, ord, end, kind)."""

    def is_ip(s: Column) -> Column:
        parts = F.transform(F.split(s["text"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))

    def is_card(s: Column) -> Column:
        number = digits(s["text"])
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))

    def is_phone(s: Column) -> Column:
        return F.length(digits(s["text"])).between(9, 15)

    found = {
        "email": (S.matches(text, EMAIL), lambda s: F.lit(True)),
        "ip": (S.matches(text, IP), is_ip),
        # Most texts have no run of digits that could be a card: they are not rewritten.
        "card": (F.when(F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")), S.matches(chained(text), CARD)), is_card),
        "phone": (S.matches(text, PHONE), is_phone),
    }
    return S.kinds(found)


def _pieces(text: Column, at: Column) -> Column:
    """Runs of letters inside ``text`` (not at its ends) as structs (start, end, term); ``at`` is its place."""
    sep = r"[^\p{L}]+"
    # split and extract see the same separators: a run of letters is what lies between two of them.
    gaps, seps = F.split(text, sep, -1), F.regexp_extract_all(text, F.lit(sep), F.lit(0))
    rows = F.arrays_zip(gaps.alias("run"), seps.alias("sep"))
    zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,term:string>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        end = state["at"] + F.length(row["run"])
        one = F.array(F.struct(state["at"].alias("start"), end.alias("end"), F.lower(row["run"]).alias("term")))
        return F.struct((end + F.coalesce(F.length(row["sep"]), F.lit(0))).alias("at"), F.concat(state["out"], one).alias("out"))

    inner = F.slice(F.aggregate(rows, zero, step, lambda s: s["out"]), 2, F.greatest(F.size(gaps) - 2, F.lit(0)))
    return F.filter(inner, lambda t: F.length(t["term"]) >= TERM_CHARS)


def with_entities(docs: DataFrame) -> DataFrame:
    """``dk tk text base m ents`` of documents with entities, written: ``m`` rows are this document, ``ents`` are the
    entities as (entity, left, before, right, after) with the text around each."""
    scanned = keyed(docs).withColumn("base", entities(F.col("text"))).filter(F.size("base") > 0)
    found = scanned.groupBy("dk", "tk").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("m"))

    def around(pieces: Column, e: Column) -> Column:
        left = F.greatest(e["start"] - CONTEXT, F.lit(0))
        name = F.concat_ws(":", e["kind"], S.taken(pieces, e["start"], e["end"]))
        return F.struct(name.alias("entity"), left.alias("left"), S.taken(pieces, left, e["start"]).alias("before"), e["end"].alias("right"), S.taken(pieces, e["end"], e["end"] + CONTEXT).alias("after"))

    return written(found.withColumn("ents", S.let(S.chunks(F.col("text")), lambda pieces: F.transform("base", lambda e: around(pieces, e)))), "entities")


def contexts(found: DataFrame) -> DataFrame:
    """``dk tk m entity start end term``, the terms around each entity."""
    rows = found.select("dk", "tk", "m", F.inline("ents"))
    return rows.select("dk", "tk", "m", "entity", F.inline(F.concat(_pieces(F.col("before"), F.col("left")), _pieces(F.col("after"), F.col("right")))))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64(text).alias("tk"), text.alias("text"))


def entity_counts(found: DataFrame) -> DataFrame:
    """``entity n``: the documents that have it."""
    return found.select("dk", "tk", "m", F.explode(F.array_distinct(F.transform("ents", lambda e: e["entity"]))).alias("entity")).groupBy("entity").agg(F.sum("m").alias("n"))


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """``term df``: counted with partial sums in each task, before anything is joined."""
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, around: DataFrame, found: DataFrame) -> DataFrame:
    """``entity term`` pairs beyond the disclosure thresholds; ``around`` are the contexts of ``docs``."""
    pairs = around.select("dk", "tk", "m", "entity", "term").distinct().groupBy("entity", "term").agg(F.sum("m").alias("co")).filter(F.col("co") >= SUPPORT)
    df = term_counts(keyed(docs), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    total = docs.agg(F.count("*").alias("total")).scalar()
    bits = F.log2(F.col("co") * total / (F.col("df") * F.col("n")))
    rated = pairs.join(df, "term").join(entity_counts(found), "entity")
    return rated.filter((F.col("co") * 100 >= F.col("df") * DISCLOSURE) & (bits >= BITS)).select("entity", "term")


def detect(docs: DataFrame) -> DataFrame:
    """``dk tk spans`` of documents with any; spans are structs (start, ord, end, kind)."""
    found = with_entities(docs)
    around = contexts(found)
    bad = disclosing(docs, around, found)
    more = around.join(bad, ["entity", "term"]).select("dk", "tk", F.struct("start", F.lit(len(KINDS)).alias("ord"), "end", F.lit("term").alias("kind")).alias("s")).distinct()
    more = more.groupBy("dk", "tk").agg(F.collect_list("s").alias("more"))
    every = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(S.KIND))))
    return found.join(more, ["dk", "tk"], "left").select("dk", "tk", every.alias("spans"))


def _terms(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(runs, lambda w: F.length(w) >= TERM_CHARS))


def alike(rows: DataFrame, name: str, *same: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``dk tk m name same...``, a name once to a document) of one name for all that stand in the same
    documents, and that name as ``first`` beside every name."""
    mark = lambda seed: F.bit_xor(F.xxhash64("dk", "tk", F.lit(seed)))
    marked = rows.groupBy(name, *same).agg(mark(1).alias("one"), mark(2).alias("two"))
    # A class is no larger than the values of one document.
    known = written(marked.select(name, *same, F.min(name).over(Window.partitionBy("one", "two", *same)).alias("first")), f"alike-{name}")
    return rows.join(known.filter(F.col("first") == F.col(name)).select(name), name), known


def disclosing_anywhere(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``term outside``: terms that disclose an entity of any frequency, and whether documents without entities hold
    them too; ``found`` as of ``with_entities``.

    A term of one document discloses if that document's rarest entity is rare enough. A term of more needs an entity
    in two of them at least (``co >= (df + 1) / 2 - share``, and ``share`` is under a half), so entities that stand
    in one document make no pairs."""
    near = found.select("dk", "tk", "m", F.explode(_terms(F.col("text"))).alias("term"))
    # No entity has a term more often than documents with entities do: the others can't reach the rate.
    most = near.groupBy("term").agg(F.sum("m").alias("most"))
    able = most.join(term_counts(keyed(docs), _terms(F.col("text"))), "term").filter((F.col("most") + SMOOTH) * 100 >= (F.col("df") + SMOOTH) * DISCLOSURE)
    able = written(able.select("term", "df", (F.col("most") < F.col("df")).alias("outside")), "able")
    total = docs.agg(F.count("*").alias("total")).scalar()
    # A rate is under one: an entity of a larger share can't be told that many bits about.
    share = entity_counts(found).select("entity", "n", (F.col("n") / total).alias("share")).filter(F.col("share") * 2**BITS <= 1)
    share = written(share, "shares")
    ents = found.select("dk", "tk", "m", F.explode(F.array_distinct(F.transform("ents", lambda e: e["entity"]))).alias("entity")).join(share, "entity")

    def discloses(co: Column) -> Column:
        rate = (co + SMOOTH * F.col("share")) / (F.col("df") + SMOOTH)
        return (rate * 100 >= DISCLOSURE) & (rate >= F.col("share") * 2**BITS)

    here = near.join(able, "term")
    rarest = ents.groupBy("dk", "tk").agg(F.min("share").alias("share"))
    single = here.filter("df = 1").join(rarest, ["dk", "tk"]).filter(discloses(F.col("m"))).select("term")
    terms, classes = alike(here.filter("df > 1").select("dk", "tk", "m", "term", "df"), "term", "df")
    firsts, _ = alike(ents.filter("n > 1").select("dk", "tk", "m", "entity", "n", "share"), "entity", "n", "share")
    pairs = terms.join(firsts.drop("m"), ["dk", "tk"]).filter(discloses(F.least("df", "n")))
    several = pairs.groupBy("entity", "term", "df", "share").agg(F.sum("m").alias("co")).filter(discloses(F.col("co"))).select(F.col("term").alias("first")).distinct()
    bad = single.union(classes.join(several, "first").select("term")).distinct()
    return bad.join(able, "term").select("term", "outside")


def small(rows: DataFrame, bound: int) -> DataFrame:
    """``rows`` (written) to be broadcast if they are counted within ``bound``."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def disclosures(docs: DataFrame) -> DataFrame:
    """``dk tk spans`` of documents with an entity or a disclosing term; spans as in ``detect``. A term that an entity
    overlaps is no span of its own."""
    found = with_entities(docs)
    bad = written(disclosing_anywhere(docs, found), "terms")
    # Whole texts are read where they lie: only those without entities that hold a disclosing term join the others.
    rest = keyed(docs).select("dk", "tk", F.explode(_terms(F.col("text"))).alias("term")).join(small(bad.filter("outside"), BROADCAST_TERMS), "term", "left_semi")
    rest = written(rest.select("dk", "tk").distinct().join(found, ["dk", "tk"], "left_anti"), "holding")
    others = keyed(docs).join(small(rest, BROADCAST_DOCUMENTS), ["dk", "tk"], "left_semi").dropDuplicates(["dk", "tk"])
    one = found.select("dk", "tk", "text").unionByName(others)
    known = small(bad.select("term"), BROADCAST_TERMS)
    # Each run of letters with the gap before it; running sums of lengths are places.
    runs = F.arrays_zip(F.split("text", r"\p{L}+", -1).alias("gap"), F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("run"))
    placed = one.select("dk", "tk", F.posexplode(runs).alias("i", "r")).filter("r.run IS NOT NULL")
    sums = F.sum(F.length("r.gap") + F.length("r.run")).over(Window.partitionBy("dk", "tk").orderBy("i"))
    placed = placed.select("dk", "tk", sums.cast("int").alias("end"), F.length("r.run").alias("size"), F.lower("r.run").alias("term"))
    terms = placed.join(known, "term", "left_semi").select("dk", "tk", (F.col("end") - F.col("size")).alias("start"), F.lit(len(KINDS)).alias("ord"), "end", F.lit("term").alias("kind"))
    every = terms.unionByName(found.select("dk", "tk", F.inline("base")))
    # In order of starts: an entity that started before reaches into the term, or one starts inside of it.
    start = F.when(F.col("ord") < len(KINDS), F.col("start"))
    upto = Window.partitionBy("dk", "tk").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # From the last start to the first: a frame that only grows is not read anew for each row, as one open to the end is.
    onward = Window.partitionBy("dk", "tk").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    every = every.withColumns({"reach": F.max(F.when(start.isNotNull(), F.col("end"))).over(upto), "next": F.min(start).over(onward)})
    free = every.filter((F.col("ord") < len(KINDS)) | (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))))
    return free.groupBy("dk", "tk").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities in ``text`` replaced by their kind, and disclosing terms by ``[term]``."""
    p = fresh(docs.columns)
    keys = {f"{p}dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), f"{p}tk": F.xxhash64(F.coalesce("text", F.lit("")))}
    found = disclosures(docs).select(F.col("dk").alias(f"{p}dk"), F.col("tk").alias(f"{p}tk"), F.col("spans").alias(f"{p}spans"))
    got = docs.withColumns(keys).join(found.hint("shuffle_hash"), list(keys), "left")
    spans = F.col(f"{p}spans")
    clean = S.replaced(F.coalesce("text", F.lit("")), F.coalesce(spans, F.array().cast(S.KIND)), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    return got.withColumn("text", F.when(spans.isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)


def _digest(docs: DataFrame, found: DataFrame, *counted: str) -> DataFrame:
    """A row per document: its spans (``found``: ``dk tk spans``), how many of the ``counted`` kinds, and a digest of
    the base ones."""
    got = keyed(docs).select("dk", "tk").join(found.hint("shuffle_hash"), ["dk", "tk"], "left")
    spans = F.coalesce("spans", F.array().cast(S.KIND))
    base = F.filter(spans, lambda s: s["ord"] < len(KINDS))
    doc_id = F.when(F.col("dk") != -(2**63), F.col("dk")).alias("doc_id")
    return got.select(doc_id, *(S.how_many(spans, k).alias(f"n_{k}") for k in counted), F.sha2(S.written_out(base), 256).alias("base_sha256"), S.written_out(spans).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(docs, disclosures(docs), *KINDS, "term")


def op10_pii_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(docs, detect(docs), *KINDS)


def _base_sql() -> str:
    """CTEs ``t`` (the texts) and ``base`` (the matches of the rules)."""
    rx = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    dig = "regexp_replace(text, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({dig}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring({dig}, length({dig}) - i + 1, 1) AS INT) ELSE (CAST(substring({dig}, length({dig}) - i + 1, 1) AS INT) * 2) // 10 + (CAST(substring({dig}, length({dig}) - i + 1, 1) AS INT) * 2) % 10 END)) % 10 = 0"
    tests = {
        "email": "true",
        "ip": "len(list_filter(string_split(text, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 999) > 255)) = 0",
        "card": f"length({dig}) BETWEEN 12 AND 19 AND {luhn_sql}",
        "phone": f"length({dig}) BETWEEN 9 AND 15",
    }
    parts = [S.matches_sql(f"m{i}", "t", "doc_id", "text", rx[k]) for i, k in enumerate(KINDS)]
    rows = [f"SELECT doc_id, start, {i} AS ord, stop, '{k}' AS kind FROM m{i} WHERE {tests[k]}" for i, k in enumerate(KINDS)]
    return f"t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {', '.join(parts)}, base AS ({' UNION ALL '.join(rows)})"


def _digest_sql(*counted: str) -> str:
    """The result from ``allspans``, as ``_digest``."""
    out = "kind || ':' || start || ':' || stop"
    return f"""agg AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS c_{k}" for k in counted)}, string_agg({out}, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < {len(KINDS)}) AS base, string_agg({out}, ',' ORDER BY start, ord, stop) AS spans FROM allspans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(c_{k}, 0) AS n_{k}' for k in counted)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN agg USING (doc_id)"""


def _sql() -> str:
    return f"""WITH {_base_sql()},
runs AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS i, unnest(g[1:len(r)]) AS gap, unnest(r) AS run FROM (SELECT doc_id, string_split_regex(text, '\\p{{L}}+') AS g, regexp_extract_all(text, '\\p{{L}}+') AS r FROM t)),
placed AS (SELECT doc_id, lower(run) AS term, length(run) AS size, CAST(sum(length(gap) + length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM runs),
near AS (SELECT DISTINCT doc_id, term FROM placed WHERE length(term) >= {TERM_CHARS}),
df AS (SELECT term, count(*) AS df FROM near GROUP BY term),
ents AS (SELECT DISTINCT doc_id, kind || ':' || substring(text, start + 1, stop - start) AS entity FROM base JOIN t USING (doc_id)),
n AS (SELECT entity, count(*) / (SELECT count(*) FROM t) AS share FROM ents GROUP BY entity),
rates AS (SELECT term, share, (count(*) + {SMOOTH} * share) / (df + {SMOOTH}) AS rate FROM ents JOIN near USING (doc_id) JOIN df USING (term) JOIN n USING (entity) GROUP BY entity, term, df, share),
bad AS (SELECT DISTINCT term FROM rates WHERE rate * 100 >= {DISCLOSURE} AND rate >= share * {2**BITS}),
terms AS (SELECT doc_id, stop - size AS start, {len(KINDS)} AS ord, stop, 'term' AS kind FROM placed JOIN bad USING (term)),
allspans AS (SELECT * FROM base UNION ALL SELECT * FROM terms x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND b.stop > x.start)),
{_digest_sql(*KINDS, 'term')}"""


def _context_sql() -> str:
    side = lambda n, text, at: f"""{n}_0 AS (SELECT doc_id, entity, {at} AS pos0, string_split_regex({text}, '[^\\p{{L}}]+') AS g, regexp_extract_all({text}, '[^\\p{{L}}]+') AS s FROM ent),
{n} AS (SELECT doc_id, entity, pos0 + list_sum(list_transform(g[1:i - 1], lambda x: length(x))) + list_sum(list_transform(s[1:i - 1], lambda x: length(x))) AS start, lower(g[i]) AS term FROM (SELECT *, unnest(range(2, len(g))) AS i FROM {n}_0) WHERE length(lower(g[i])) >= {TERM_CHARS})"""  # noqa: E731
    return f"""WITH {_base_sql()},
ent AS (SELECT doc_id, kind || ':' || substring(text, start + 1, stop - start) AS entity, greatest(start - {CONTEXT}, 0) AS a, stop AS b,
  substring(text, greatest(start - {CONTEXT}, 0) + 1, start - greatest(start - {CONTEXT}, 0)) AS l, substring(text, stop + 1, {CONTEXT}) AS r FROM base JOIN t USING (doc_id)),
{side('sl', 'l', 'a')}, {side('sr', 'r', 'b')}, around AS (SELECT * FROM sl UNION ALL SELECT * FROM sr),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS co FROM around GROUP BY ALL HAVING count(DISTINCT doc_id) >= {SUPPORT}),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}]+'))) AS term FROM t) GROUP BY term),
n AS (SELECT entity, count(DISTINCT doc_id) AS n FROM ent GROUP BY entity),
bad AS (SELECT entity, term FROM pairs JOIN df USING (term) JOIN n USING (entity) WHERE co * 100 >= df * {DISCLOSURE} AND log2(co * (SELECT count(*) FROM t) / (df * n)) >= {BITS}),
allspans AS (SELECT * FROM base UNION ALL SELECT DISTINCT doc_id, start, {len(KINDS)}, start + length(term), 'term' FROM around JOIN bad USING (entity, term)),
{_digest_sql(*KINDS)}"""


QUERIES = {"op10_pii": op10_pii, "op10_pii_context": op10_pii_context}
ORACLES = {"op10_pii": _sql(), "op10_pii_context": _context_sql()}
