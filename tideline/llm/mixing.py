"""A mix of documents whose sources get target weights, where a document may belong to several sources.

Documents are aggregated by membership pattern (the set of their sources). A min-cost flow routes the tokens of the
patterns to the sources' quotas: the k-th use of a pattern's documents costs k - 1, so no repetition is planned while an
unused document can still serve the quota. Costs lie on the first arc of a path only, and an augmenting path never gives
that arc back; so the flow over uses of one cost after the other is the cheapest one, and each of its paths starts at a
source that lacks tokens and reroutes what other sources take from a shared pattern.

Documents then stand in the order of a seeded digest, one after the other by size; each source gets a stretch of its
patterns' order (of as many rounds as there are uses), and a document goes to the stretch that holds its middle. Large
documents (above a tenth of their pattern's planned words) are placed first, then those above a hundredth, then those
above a thousandth, and each tier shares what the ones before it left open, so that a source's words miss its quota by
about half a small document. A pattern's order is dealt by the digest's first digits and shifted by their sums, so one
that a third of all documents share spreads over many tasks.

What reaches the driver is a row per pattern and source of it: labels of a recipe that is written for them. Beyond
``PATTERNS`` patterns it is an error, not a cut.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; no
sources at all (an empty or null array) is a pattern that serves none; repeated rows are documents each, and equal rows
can get different shares; an empty table gives an empty result; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideline.llm.common import SPACE, table, written

SEED, USES, SHARE = 42, 2, Fraction(3, 2)
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Most patterns that a plan is made for, and most of its rows that are broadcast.
PATTERNS, BROADCAST_PATTERNS = 1_000_000, 50_000
#: Hexadecimal digits of the digest that deal a pattern's order to tasks.
DIGITS = 3
#: Sizes part documents at these shares of their pattern's planned words, if above that share of all its words, too.
TIERS, LEAST_OF_ALL = (10, 100, 1_000), 100_000


def targets(sizes: dict, weights: dict, share: Fraction = SHARE, uses: int = USES) -> dict:
    """Words of each source: ``share`` of all words by weight, at most ``uses`` times the source's own; what is above
    that is shared among the others by weight until none is above."""
    left, open_ = share * sum(sizes.values()), {s for s in sizes if weights[s]}
    out = {s: Fraction(0) for s in sizes}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > uses * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        out |= {s: Fraction(uses * sizes[s]) for s in full}
        left -= sum(uses * sizes[s] for s in full)
        open_ -= full
    return out


def cheapest_flow(patterns: dict[tuple, int], quotas: dict, uses: int = USES) -> dict[tuple, dict]:
    """Words of each pattern that each of its sources takes: ``pattern -> source -> words``. As much of the quotas as
    can be met, with as few repetitions as can be."""
    members = defaultdict(list)
    for pattern in patterns:
        for source in pattern:
            members[source].append(pattern)
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    lack = dict(quotas)
    for _ in range(uses):
        free = {p: n + 0 for p, n in patterns.items()}  # of this use
        for source in quotas:
            while lack[source] > 0:
                # from the source over patterns: one with free words ends the path, one that serves another source leads to it
                came, queue, end = {source: None}, deque([source]), None
                while queue and end is None:
                    at = queue.popleft()
                    for p in members[at]:
                        if free[p] > 0:
                            end = (p, at)
                            break
                        for other, words in flow[p].items():
                            if words > 0 and other not in came:
                                came[other] = (p, at)
                                queue.append(other)
                if end is None:
                    break
                path, (p, at) = [], end
                amount = min(free[p], lack[source])
                while came[at] is not None:
                    via, before = came[at]
                    path.append((via, at, before))
                    amount, at = min(amount, flow[via][at]), before
                free[p] -= amount
                flow[p][end[1]] += amount
                for via, loser, winner in path:
                    flow[via][loser] -= amount
                    flow[via][winner] += amount
                lack[source] -= amount
    return flow


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(f"[^{SPACE}]+"))).cast("long")


def _plan(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    plan = spark.createDataFrame(rows, schema)
    return F.broadcast(plan) if len(rows) <= BROADCAST_PATTERNS else plan


def _place(rows: DataFrame, cuts: dict[str, list[tuple]], uses: int) -> DataFrame:
    """``rows`` (``key size digest``) with ``routed``: the sources, one for each use, whose stretch of the order of their
    pattern ``key`` holds their middle. ``cuts`` has the stretches ``(source, words)`` of a pattern in order."""
    spark, plan = rows.sparkSession, []
    for key, stretches in cuts.items():
        end, ends = 0, []
        for source, words in stretches:
            end += words
            ends.append((source, end))
        plan.append((key, ends))
    dealt = rows.withColumn("deal", F.substring("digest", 1, DIGITS))
    sums = dealt.groupBy("key", "deal").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("key").orderBy("deal")  # 16 ** DIGITS rows at most
    sums = sums.select("key", "deal", (F.sum("words").over(ordered) - F.col("words")).alias("before"), F.sum("words").over(Window.partitionBy("key")).alias("total"))
    local = F.sum("size").over(Window.partitionBy("key", "deal").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("local", local).join(sums, ["key", "deal"]).join(_plan(spark, plan, "key string, cuts array<struct<source:string, end:long>>"), "key")

    def middle(use: Column) -> Column:
        at = 2 * (use * F.col("total") + F.col("before") + F.col("local")) + F.col("size")
        held = F.filter("cuts", lambda c: at < 2 * c["end"])
        return F.when((F.col("size") > 0) & (F.size(held) > 0), F.struct(F.get(held, F.lit(0))["source"].alias("source"), F.col("size").alias("words")))

    routed = F.filter(F.transform(F.sequence(F.lit(0), F.lit(uses - 1)), middle), lambda r: r.isNotNull())
    return placed.withColumn("routed", routed).drop("deal", "local", "before", "total", "cuts")


def mix(docs: DataFrame, quotas_of, uses: int = USES, seed: int = SEED, id_col: str = "doc_id", size: Column | None = None, sources: Column | None = None) -> tuple[DataFrame, dict]:
    """A row per document: ``doc_id size sources routed taken``; ``routed`` has a source and its words for each use. The
    second part of the result is what ``quotas_of`` gave for the sources' sizes: the words that each is to get."""
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    sources = F.array("source") if sources is None else sources
    members = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), members.alias("sources"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = written(sized.withColumns({"key": F.to_json("sources", {"ignoreNullFields": "false"}), "digest": digest}), "sized")
    totals = sized.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"))
    found = totals.limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sets of sources: group rare sources before they are mixed")
    patterns = {tuple(r["sources"]): (r["key"], r["words"]) for r in found}
    sizes = defaultdict(int)
    for pattern, (_, words) in patterns.items():
        for source in pattern:
            sizes[source] += words
    quotas = quotas_of(dict(sizes))
    order = sorted(sizes, key=lambda s: (s is None, s))
    flow = cheapest_flow({p: w for p, (_, w) in sorted(patterns.items(), key=lambda x: x[1][0])}, {s: int(quotas[s]) for s in order}, uses)
    planned = {patterns[p][0]: [(s, w) for s, w in sorted(f.items(), key=lambda x: (x[0] is None, x[0]))] for p, f in flow.items()}
    words = {key: w for key, w in patterns.values()}
    bounds = [(key, [max(sum(w for _, w in f) // share, words[key] // LEAST_OF_ALL, 1) for share in TIERS]) for key, f in planned.items()]
    tier = F.size(F.filter("bounds", lambda b: F.col("size") <= b))
    split = sized.join(_plan(spark, bounds, "key string, bounds array<long>"), "key").withColumn("tier", tier).drop("bounds")
    held = defaultdict(int)  # words of a pattern's tiers, at most four to a pattern
    for r in split.groupBy("key", "tier").agg(F.sum("size").alias("words")).collect():
        held[r["key"], r["tier"]] = r["words"]
    out, left = None, {(key, s): w for key, f in planned.items() for s, w in f}
    for k in range(len(TIERS) + 1):
        cuts = {}
        for key, f in planned.items():
            here, below = held[key, k], sum(held[key, j] for j in range(k, len(TIERS) + 1))
            cuts[key] = [(s, max(0, left[key, s]) * here // below if here else 0) for s, _ in f]
        placed = _place(split.filter(F.col("tier") == k), cuts, uses)
        if k < len(TIERS):
            placed = written(placed, "placed")
            for r in placed.select("key", F.inline("routed")).groupBy("key", "source").agg(F.sum("words").alias("words")).collect():  # a row per pattern and source
                left[r["key"], r["source"]] -= r["words"]
        out = placed if out is None else out.unionByName(placed)
    return out.select("doc_id", "size", "sources", "routed", (F.col("size") * F.size("routed")).alias("taken")), quotas


def repeating(sizes: dict) -> dict:
    """Weights of the sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    of: dict = {}

    def quotas(sizes):
        of.update(sizes)
        return targets(sizes, repeating(sizes))

    mixed, wanted = mix(table(spark, sf_dir, "documents"), quotas)
    goals = _plan(spark, [(s, of[s], float(wanted[s])) for s in of], "source string, source_size long, target double")
    mixed = mixed.withColumn("source", F.get("sources", F.lit(0)))
    return mixed.join(goals, mixed["source"].eqNullSafe(goals["source"])).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op12_mixture": op12_mixture}
ORACLES: dict[str, str] = {}
