"""SimHash near-duplicates found through a segment-popcount embedding.

Fingerprints are cut into 32 segments of two bits and mapped to the vector of their bit counts. The Manhattan
distance of two vectors is never above the Hamming distance of the fingerprints. Each count is stored in unary
(0 -> 00, 1 -> 01, 2 -> 11), so the vector is one 64-bit number and the Manhattan distance is the number of
bits in which two of them differ.

Grid range-join: the segments form ``g`` groups. Vectors within ``radius`` differ in at most ``radius`` groups, so
they are equal in some ``g - radius`` of them; for each such choice a fingerprint goes to the grid cell of its counts
there, and the rows of a cell meet. Candidates are dropped by the Manhattan distance of the whole vectors and then
verified by the exact Hamming distance. A task unites what it verified and returns few links, never all pairs.

The grid follows the corpus: more groups make narrower cells and more of them. ``grid`` takes the number of groups
with the least work for the counted fingerprints, so that the candidates of a fingerprint stay few (see
``expected``); every grid gives the same links.

Equal fingerprints are one node, so copies don't multiply. A cell with more than ``hot`` rows is dealt to
several tasks: its rows as targets by their hash, and as probes to each of them. A task reads its cells in order and
holds the targets of one cell, ``hot`` or about so many, and a batch of probes. Fingerprints that very many documents
have get their component by a broadcast of bounded size, the others by a join.

Defined cases: a null, empty or blank text has fingerprint zero and is linked as any other; null ids keep
their row (a component without any id has a null one); repeated rows keep their number; extra columns are
ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm.common import partitions, table, written
from tideline.operators.components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows of a cell beyond which it is dealt to several tasks.
HOT = 40_000
#: Hot cells up to so many (16 bytes each) are broadcast.
BROADCAST_CELLS = 100_000
#: Candidates compared at a time in a task.
PAIRS = 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint per run of ``hashes`` (run lengths in ``counts``; zero for an empty run)."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        over = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > counts[full][:, None]
        out[full] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``; the 64 bits of ``fp`` are those of the unsigned fingerprint."""

    def run(batches):
        for batch in batches:
            found, hashes, counts, held = [], [], [], 0
            for text in batch.column(1).to_pylist():
                got = shingle_hashes((text or "").encode(), size)
                hashes.append(np.array(got, np.uint64))
                counts.append(len(got))
                held += len(got)
                if held > 100_000:
                    found.append(majority(np.concatenate(hashes), np.array(counts)))
                    hashes, counts, held = [], [], 0
            if counts:
                found.append(majority(np.concatenate(hashes), np.array(counts)))
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


EVEN = np.uint64(0x5555555555555555)


def embed(fp: np.ndarray) -> np.ndarray:
    """Unary bit counts of the 32 two-bit segments."""
    high = fp >> np.uint64(1)
    return ((fp | high) & EVEN) | ((fp & high & EVEN) << np.uint64(1))


#: Work of sending a row to a cell, in comparisons of candidates.
ROW_COST = 100


def expected(nodes: int, groups: int, radius: int = RADIUS) -> tuple[int, float]:
    """Cells of a fingerprint, and the candidates that evenly spread fingerprints make there. Two counts of a segment
    are equal with a chance of 3/8."""
    rows = comb(groups, radius)
    return rows, nodes * rows * (3 / 8) ** (32 * (groups - radius) / groups)


def grid(nodes: int, radius: int = RADIUS) -> int:
    """The number of groups with the least work for so many fingerprints; a cell fixes two groups at least."""
    return min(range(radius + 2, 17), key=lambda g: expected(nodes, g, radius)[0] * ROW_COST + expected(nodes, g, radius)[1])


def masks(groups: int, radius: int) -> list[np.uint64]:
    """For each choice of ``groups - radius`` groups the bits of their segments."""
    of = [sum(3 << (2 * s) for s in range(32 * g // groups, 32 * (g + 1) // groups)) for g in range(groups)]
    return [np.uint64(sum(c)) for c in combinations(of, groups - radius)]


def cells(nodes: DataFrame, radius: int, groups: int) -> DataFrame:
    """``grp, cell, fp``: the grid cells that a fingerprint is in."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vector = embed(fp.view(np.uint64))
            for g, mask in enumerate(masks(groups, radius)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array((vector & mask).view(np.int64)), pa.array(fp)], ["grp", "cell", "fp"])

    return nodes.select("fp").mapInArrow(run, "grp int, cell long, fp long")


def _candidates(cell: np.ndarray, target: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (probe, target) of rows of a cell, in blocks; rows are sorted by cell, targets first."""
    first = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]).astype(np.int64)
    n_targets = np.add.reduceat(target.astype(np.int64), first[:-1])
    many, size = np.where(probe, np.repeat(n_targets, np.diff(first)), 0), np.diff(first)
    begin = np.repeat(first[:-1], size)
    ends = np.cumsum(many)
    at = 0
    while at < len(cell):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = many[at:to]
        probes = np.repeat(np.arange(at, to), n)
        place = np.arange(len(probes)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
        yield probes, place
        at = to


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link (node, smallest node reached) for each node of the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT, groups: int | None = None) -> DataFrame:
    """``a, b``: links between fingerprints within ``radius`` that connect all that the pairs would."""
    spark = nodes.sparkSession
    rows = cells(nodes, radius, groups or grid(nodes.count(), radius))
    crowded = written(rows.groupBy("grp", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        rows = rows.join(F.broadcast(crowded) if n_crowded <= BROADCAST_CELLS else crowded, ["grp", "cell"], "left")
        parts = F.ceil(F.coalesce("n", F.lit(1)) / hot).cast("int")
        mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
        rows = rows.select("grp", "cell", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        rows = rows.select("grp", "cell", "part", (F.col("mine") == F.col("part")).alias("target"), "fp")
    else:
        rows = rows.select("grp", "cell", F.lit(0).alias("part"), F.lit(True).alias("target"), "fp")
    dealt = rows.repartition(partitions(spark), "grp", "cell", "part").sortWithinPartitions("grp", "cell", "part", F.desc("target"))

    def run(batches):
        held, key, found, many = np.zeros(0, np.uint64), None, [], 0

        def united():
            a, b = unite(*(np.concatenate(x) for x in zip(*found, strict=True)))
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            grp, cell, part, target, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            fp = fp.view(np.uint64)
            number = np.cumsum(np.concatenate([[0], (grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
            # Targets of the cell that the last batch ended in are met by the rows of it that follow.
            if key != (grp[0], cell[0], part[0]):
                held = held[:0]
            n = len(held)
            fp, number = np.concatenate([held, fp]), np.concatenate([np.zeros(n, number.dtype), number])
            target, probe = np.concatenate([np.ones(n, bool), target.astype(bool)]), np.arange(n + len(batch)) >= n
            vector = embed(fp)
            for p, t in _candidates(number, target, probe):
                near = np.bitwise_count(vector[p] ^ vector[t]) <= radius  # the Manhattan distance
                p, t = p[near], t[near]
                near = (np.bitwise_count(fp[p] ^ fp[t]) <= radius) & (fp[p] != fp[t])
                if near.any():
                    found.append((fp[p[near]], fp[t[near]]))
                    many += int(near.sum())
                if many > 4 * PAIRS:
                    yield united()
                    found, many = [], 0
            key, held = (grp[-1], cell[-1], part[-1]), fp[(number == number[-1]) & target]
        if found:
            yield united()

    return dealt.mapInArrow(run, "a long, b long")


#: Documents of one fingerprint beyond which it takes no part in a join by it.
COPIES, MOST_COPIED = 20_000, 100_000


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, fp, component_id`` (smallest id reachable over links)."""
    marked = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = connected_components(written(links(nodes, radius), "links"), "a", "b", lambda df: written(df, "stars"))
    linked = nodes.join(found, nodes["fp"] == found["node"])
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = linked.join(least, "component").select("fp", "least")
    of = written(nodes.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "components")
    # At most MOST_COPIED fingerprints have more documents than this.
    often = max(copies, marked.count() // MOST_COPIED)
    copied = F.broadcast(of.filter(F.col("n") > often).select("fp", "component_id"))
    others = marked.join(copied.select("fp"), "fp", "left_anti").join(of.filter(F.col("n") <= often).select("fp", "component_id"), "fp")
    return others.unionByName(marked.join(copied, "fp")).select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Repeated rows of it stay once; a row
    without an id can't be told from others, so it stays."""
    groups = near_duplicates(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # The semi join leaves the rows dealt by doc_id, which the grouping of repeated rows takes as it is.
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLES: dict[str, str] = {}
