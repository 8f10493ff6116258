"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words at the set positions of a fixed mask; words at the other positions of its window
don't matter. Seeds of the benchmark items and of the documents are joined; hits of one item in one document
fall on diagonals (document position minus item position). The overlap around hits is verified word by word: the
words of the item that stand in place on a diagonal with a hit, united over these diagonals, so that words may be
substituted, put in or left out. An item contaminates a document that has ``SHARE`` hundredths of its words, or a
stretch of the item with ``STRETCH`` of its words and no gap of more than ``GAP``. Only built-in functions are used.

Words are lower-cased runs of letters and digits. The masks have five words each; items shorter than a window
of the shortest mask are compared by a seed of all their words ("whole" mask of their length up to that). An item
of fewer than ``LEAST`` words is no passage: only a document that consists of just these words is contaminated.

The benchmark's seeds are broadcast only while they are at most ``BROADCAST_SEEDS`` (counted first); beyond that
seeds of documents pass a bitmap of the benchmark's seeds (16 MB at most) and what is left is joined by a shuffle,
where adaptive skew splitting applies. Hits are united per document, item and block of ``BLOCK`` diagonals; a row
holds one such block, however repetitive the text. The hits are written; then a bitmap of the documents that have
one (16 MB at most, whatever their number) is broadcast, so that only texts with a hit, and few others, are sent to
meet their hits. Every text is read twice where it lies.

Defined cases: null or empty texts and items have no words and match nothing; null item ids are left out; equal
items each count; repeated rows of a document get the same answer; rows of one id with different texts are
judged apart; null document ids are kept; an empty benchmark or table leaves nothing contaminated; extra
columns are ignored by the query and kept by the stage. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm.common import fresh, table, written

#: Fixed masks; '1' marks a position whose word counts.
MASKS = ("1101101", "11100101")
#: Hundredths of an item's words that must stand in place.
SHARE = 80
#: Words of a stretch of an item that count whatever the item's length, and the words that may be missing in a row.
STRETCH, GAP = 20, 2
#: Words from which an item is sought inside of documents.
LEAST = 3
#: Seeds (a hash, an item, a position: 24 bytes) up to which the benchmark side is broadcast, and items likewise.
BROADCAST_SEEDS, BROADCAST_ITEMS = 500_000, 20_000
#: Diagonals in a row at most.
BLOCK = 1024
#: Bits of a bitmap of seeds or of documents, in rows of 4 kB; ``ROW`` bits each.
BITS, ROW = 1 << 27, 1 << 15
SHORTEST = min(map(len, MASKS))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(words: Column) -> Column:
    """An array of (mask, pos, seed) over the word hashes; the last kind is for items below a mask's length."""

    def of(number: int, mask: str) -> Column:
        on = [i for i, c in enumerate(mask) if c == "1"]
        made = F.transform(
            F.sequence(F.lit(0), F.size(words) - len(mask)),
            lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(number), *(F.get(words, p + i) for i in on)).alias("seed")),
        )
        return F.when(F.size(words) >= len(mask), made).otherwise(F.array().cast(SEED))

    return F.concat(*(of(i, m) for i, m in enumerate(MASKS)))


SEED = "array<struct<pos:int,seed:long>>"


def short_seeds(words: Column, lengths: list[int]) -> Column:
    """Seeds of all words of a window, for the lengths of items that no mask fits."""

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(-n), *(F.get(words, p + i) for i in range(n))).alias("seed")))
        return F.when(F.size(words) >= n if n >= LEAST else F.size(words) == n, made).otherwise(F.array().cast(SEED))

    return F.concat(*map(of, lengths)) if lengths else F.array().cast(SEED)


def keyed(docs: DataFrame) -> DataFrame:
    """(dk, tk) tells documents apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64(text).alias("tk"), text.alias("text"))


def slot(key: str) -> dict[str, Column]:
    """Row and bit of a hash in the bitmap."""
    at = F.pmod(F.expr(key), F.lit(BITS))
    return {"row": F.floor(at / ROW), "bit": F.pmod(at, F.lit(ROW))}


def possible(mine: DataFrame, made: DataFrame, key: str = "seed") -> DataFrame:
    """Rows of ``mine`` whose ``key`` (SQL of a hash) may be one of ``made``: all that are, and few others."""
    bitmap = made.withColumns(slot(key)).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bitmap"))  # BITS / ROW rows at most
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = mine.withColumns(slot(key)).join(F.broadcast(bitmap), "row")
    return placed.filter(F.call_function("getbit", byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1).select(*mine.columns)


def contamination(docs: DataFrame, items: DataFrame, share: int = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``dk tk n_items item_ids best``: contaminated documents, their items (comma-joined, in order) and the
    greatest share of an item's words found in place, in hundredths."""
    items = items.filter("item_id IS NOT NULL").select("item_id", word_hashes(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    lengths = sorted(r["n"] for r in items.filter(F.size("iw") < SHORTEST).select(F.size("iw").alias("n")).distinct().collect())  # at most SHORTEST - 1
    whole = F.when(F.size("iw") < SHORTEST, F.array(F.struct(F.lit(0).alias("pos"), F.coalesce(*(F.when(F.size("iw") == n, F.xxhash64(F.lit(-n), *(F.get("iw", F.lit(i)) for i in range(n)))) for n in range(1, SHORTEST))).alias("seed"))))
    made = items.select("item_id", F.inline(F.concat(seeds(F.col("iw")), F.coalesce(whole, F.array().cast(SEED))))).select("item_id", F.col("pos").alias("ipos"), "seed").distinct()
    base = keyed(docs)
    words = base.select("dk", "tk", word_hashes(F.col("text")).alias("w"))
    mine = words.select("dk", "tk", F.inline(F.concat(seeds(F.col("w")), short_seeds(F.col("w"), lengths))))
    hits = mine.join(F.broadcast(made), "seed") if made.count() <= broadcast_seeds else possible(mine, made).join(made, "seed")
    hits = hits.select("dk", "tk", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"))
    blocks = hits.groupBy("dk", "tk", "item_id", F.floor(F.col("diagonal") / BLOCK).alias("block")).agg(F.collect_set("diagonal").alias("diagonals"))
    blocks = written(blocks, "hits")
    tried = blocks.join(F.broadcast(items) if items.count() <= BROADCAST_ITEMS else items, "item_id")
    met = possible(base, blocks, "xxhash64(dk, tk)")
    placed = met.join(tried.hint("shuffle_hash"), ["dk", "tk"]).select("dk", "tk", "item_id", "iw", "diagonals", word_hashes(F.col("text")).alias("w"))

    def in_place(g: Column) -> Column:
        there = lambda k: F.try_element_at(F.col("w"), F.when(g + k >= 0, g + k + 1)) == F.get("iw", k)
        return F.filter(F.sequence(F.lit(0), F.size("iw") - 1), lambda k: F.coalesce(there(k), F.lit(False)))

    found = placed.select("dk", "tk", "item_id", F.size("iw").alias("n"), F.array_distinct(F.flatten(F.transform("diagonals", in_place))).alias("places"))
    united = found.groupBy("dk", "tk", "item_id", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("p"))
    apart = lambda i: (i == 0) | (i == F.size("p")) | (F.get("p", i) - F.get("p", i - 1) > GAP + 1)
    united = united.withColumn("edges", F.filter(F.sequence(F.lit(0), F.size("p")), lambda i: F.coalesce(apart(i), F.lit(True))))
    longest = F.array_max(F.transform("edges", lambda e, i: F.coalesce(F.get("edges", i + 1) - e, F.lit(0))))
    hit = united.filter((F.size("p") * 100 >= F.col("n") * share) | (longest >= STRETCH)).select("dk", "tk", "item_id", F.floor(F.size("p") * 100 / F.col("n")).cast("long").alias("pct"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return hit.groupBy("dk", "tk").agg(F.count("*").alias("n_items"), ids.alias("item_ids"), F.max("pct").alias("best"))


def decontaminate(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """A row per row of ``docs``: ``doc_id contaminated n_items item_ids best_share``."""
    keys = keyed(docs).select("dk", "tk")
    got = keys.join(contamination(docs, items, share).hint("shuffle_hash"), ["dk", "tk"], "left")
    doc_id = F.when(F.col("dk") != -(2**63), F.col("dk")).alias("doc_id")
    return got.select(doc_id, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("best", F.lit(0)).alias("best_share"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with the columns they came with."""
    bad = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("dk", "tk")
    text = F.coalesce(F.col("text"), F.lit(""))
    p = fresh(docs.columns)
    marked = docs.withColumns({f"{p}dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), f"{p}tk": F.xxhash64(text)})
    on = (marked[f"{p}dk"] == bad["dk"]) & (marked[f"{p}tk"] == bad["tk"])
    return marked.join(bad.hint("shuffle_hash"), on, "left_anti").select(*docs.columns)


def _sql() -> str:
    tok = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    lens = ", ".join(f"({i}, {len(m)}, [{', '.join(str(k + 1) for k, c in enumerate(m) if c == '1')}])" for i, m in enumerate(MASKS))
    seed = lambda src: f"SELECT key, m, p, list_transform(pat, lambda k: w[p + k]) AS s FROM (SELECT key, w, m, pat, unnest(range(0, len(w) - n + 1)) AS p FROM {src}, masks WHERE len(w) >= n)"
    return f"""WITH masks(m, n, pat) AS (VALUES {lens}),
d AS (SELECT doc_id AS key, {tok('text')} AS w FROM documents), i AS (SELECT item_id AS key, {tok('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({seed('d')}), bs AS ({seed('i')}),
hits AS (SELECT DISTINCT ds.key AS doc_id, bs.key AS item_id, ds.p - bs.p AS g FROM ds JOIN bs USING (m, s)
  UNION SELECT d.key, i.key, q.p FROM d, i, LATERAL (SELECT unnest(range(0, len(d.w) - len(i.w) + 1)) AS p) q WHERE len(i.w) BETWEEN 1 AND {SHORTEST - 1} AND (len(i.w) >= {LEAST} OR len(d.w) = len(i.w)) AND d.w[q.p + 1:q.p + len(i.w)] = i.w),
pl AS (SELECT DISTINCT doc_id, item_id, k, len(iw) AS n FROM (SELECT hits.doc_id, hits.item_id, d.w AS dw, i.w AS iw, g, unnest(range(1, len(i.w) + 1)) AS k FROM hits JOIN d ON d.key = hits.doc_id JOIN i ON i.key = hits.item_id)
  WHERE k + g BETWEEN 1 AND len(dw) AND dw[k + g] = iw[k]),
isl AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS isle FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) <= {GAP + 1} THEN 0 ELSE 1 END AS edge FROM pl)),
run AS (SELECT doc_id, item_id, n, isle, count(*) AS c FROM isl GROUP BY ALL),
h AS (SELECT doc_id, item_id, CAST(floor(sum(c) * 100 / n) AS BIGINT) AS pct FROM run GROUP BY doc_id, item_id, n HAVING sum(c) * 100 >= n * {SHARE} OR max(c) >= {STRETCH}),
a AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(pct) AS best FROM h GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(best, 0) AS best_share
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)"""


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
ORACLES = {"op8_benchmark_decontamination": _sql()}
