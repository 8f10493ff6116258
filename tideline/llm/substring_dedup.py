"""Removal of word windows that occur more than once, behind a count-min prefilter.

First pass: every window has an anchor (see ``repeats``). A partition of the texts makes count-min sketches of its anchors,
one for each slice of the hashes: the cells that they touch, in order, as gaps of a byte or two, with a mark where the
partition alone counts two. The sketches of a slice are merged by addition, in counters that stop at two, and the slice
tells each partition which of its cells reached two. Neither anchors nor places travel: two bytes an anchor do for eight
partitions, four for two hundred up to some thousands. A merged slice holds two bits for each of ``ROOM`` cells to an
anchor in ``DEPTH`` rows. An anchor occurs at least as often as any window that has it, and a sketch never counts too
little, so no repeated window is lost; about 5 % of unique anchors or less pass wrongly, at every size of the corpus, as
the sketches are sized by its bytes.
Second pass: the partition's texts are read again behind what the slices told it, and windows whose anchor is estimated
repeated are grouped exactly, by 128-bit hashes of their words.

Defined cases: a null or blank text has no words and keeps none; texts of fewer than ``width`` words keep all;
rows equal in id and text are separate documents that repeat each other, rows of one id with different texts
are different documents; null ids are allowed; an empty table gives an empty result; extra columns are ignored.
Texts are read whole, in chunks that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import repeats as R
from tideline.llm.common import partitions, table

WIDTH, GRAM = 35, 18
DEPTH, ROOM = 2, 4
#: Bytes of a word and the gap behind it, which only size the sketches.
WORD_BYTES = 6
CHUNK, BLOCK = 100_000, 150_000
SKETCHED = "slice int, part int, cells binary, twice binary"
TOLD = "part int, slice int, cells binary"


def word_lanes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def blocks(texts: list[str], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole chunks: (lanes, chunk sizes, document of each chunk, its first word in the document)."""
    words: list[bytes] = []
    sizes: list[int] = []
    docs: list[int] = []
    bases: list[int] = []
    for i, text in enumerate(texts):
        split = (text or "").encode().split()
        for base in range(0, max(1, len(split) - width + 1), CHUNK):
            part = split[base : base + CHUNK + width - 1]
            if len(part) < width:
                continue
            words += part
            sizes.append(len(part))
            docs.append(i)
            bases.append(base)
            if len(words) >= BLOCK:
                yield word_lanes(words), np.array(sizes), np.array(docs), np.array(bases)
                words, sizes, docs, bases = [], [], [], []
    if words:
        yield word_lanes(words), np.array(sizes), np.array(docs), np.array(bases)


def packed(cells: np.ndarray) -> bytes:
    """Ascending numbers as gaps of seven bits to a byte, the last byte of a gap below 128."""
    gaps = np.diff(cells, prepend=0)
    size = np.maximum(1, sum((gaps >= 1 << (7 * k)).astype(np.int64) for k in range(10)))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[ends[has] - size[has] + k] = (gaps[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    last = raw < 128
    begins = np.flatnonzero(np.append(True, last[:-1])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127) << (7 * place), begins)) if len(begins) else begins


def cells_of(keys: np.ndarray, log_width: int) -> list[np.ndarray]:
    """The cell of each key in each row of a sketch, numbered through its rows."""
    return [(np.int64(i) << log_width) | (R.mix(keys, 11 + i) >> np.uint64(64 - log_width)).astype(np.int64) for i in range(DEPTH)]


class Sketch:
    """Merged count-min counters that stop at two, as two planes of bits."""

    def __init__(self, log_width: int):
        self.once, self.twice = (np.zeros((DEPTH << log_width) // 8 + 1, np.uint8) for _ in range(2))

    def merge(self, cells: np.ndarray, twice: np.ndarray) -> None:
        """The sketch of a partition: the cells that it touches, in order, and which of them it counts twice."""
        if not len(cells):
            return
        byte, bit = cells >> 3, np.uint8(1) << (cells & 7).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        at, one = byte[first], np.bitwise_or.reduceat(bit, first)
        self.twice[at] |= (self.once[at] & one) | np.bitwise_or.reduceat(np.where(twice, bit, np.uint8(0)), first)
        self.once[at] |= one

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self.twice[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 > 0


def sketches(anchors: np.ndarray, log_width: int, n_slices: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A partition's sketch of each slice: (slice, cells in order, which it counts twice)."""
    slices = R.bucket_of(anchors, n_slices).astype(np.int64) * (DEPTH << log_width)
    numbers, counts = np.unique(np.concatenate([slices + c for c in cells_of(anchors, log_width)]), return_counts=True)
    of = numbers // (DEPTH << log_width)
    edges = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of)) if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(of[a]), numbers[a:b] - of[a] * (DEPTH << log_width), counts[a:b] > 1


def parted(base: DataFrame) -> DataFrame:
    """The texts by partition, through the exchange that the last join reads again."""
    n = partitions(base.sparkSession)
    # Hash partitioning deals a row to this number.
    return base.repartition(n, "dk", "tk").withColumn("part", F.pmod(F.hash("dk", "tk"), F.lit(n)))


def told(base: DataFrame, log_width: int, width: int, gram: int) -> DataFrame:
    """``part slice cells``: those cells of a partition's sketches that count two or more in the whole corpus."""
    n_slices = partitions(base.sparkSession)

    def sketch(batches):
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, texts in by_part(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                found.setdefault(part, []).extend(R.runs_of(lanes[:, 0], sizes, width, gram).anchor for lanes, sizes, _, _ in blocks(texts, width))
        for part, anchors in found.items():
            rows = [(s, part, packed(cells), np.packbits(twice).tobytes()) for s, cells, twice in sketches(np.concatenate(anchors), log_width, n_slices)] if anchors else []
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "part", "cells", "twice"])

    def merge(batches):
        rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        for s in sorted({row[0] for row in rows}):
            merged, own = Sketch(log_width), [row for row in rows if row[0] == s]
            for _, _, data, twice in own:
                cells = unpacked(data)
                merged.merge(cells, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells)).astype(bool))
            for _, part, data, _ in own:
                cells = unpacked(data)
                cells = cells[merged.repeated(cells)]
                if len(cells):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s], pa.int32()), pa.array([packed(cells)], pa.binary())], ["part", "slice", "cells"])

    made = parted(base).select("part", "text").mapInArrow(sketch, SKETCHED)
    return made.repartitionById(n_slices, F.col("slice")).mapInArrow(merge, TOLD)


def by_part(parts: np.ndarray, texts: list) -> Iterator[tuple[int, list]]:
    for part in np.unique(parts).tolist():
        yield part, [t for t, p in zip(texts, parts.tolist(), strict=True) if p == part]


def sketch_width(base: DataFrame, width: int, gram: int) -> int:
    """Bits of the cells of a slice's row: ``ROOM`` cells or more to each anchor that so many bytes of text may have."""
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = size / WORD_BYTES * 2 / (width - gram + 2) / partitions(base.sparkSession)
    return max(10, int(ROOM * anchors).bit_length())


def repeated_windows(base: DataFrame, log_width: int | None = None, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``dk tk places``: spans of windows whose word sequence starts more than once; ``base`` has ``dk tk text``.
    ``log_width`` fixes the width of the sketches, which follows the bytes of the texts otherwise."""
    base = base.select("dk", "tk", "text")
    n_buckets = partitions(base.sparkSession)
    bits = log_width or sketch_width(base, width, gram)

    def anchors_of(texts):
        found = [R.runs_of(lanes[:, 0], sizes, width, gram).anchor for lanes, sizes, _, _ in blocks(texts, width)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    hot = R.hot_anchors(base, anchors_of, n_buckets)

    def deal(batches):
        dealer, now, cells, known = R.Dealer(n_buckets, 2), None, [], None
        for batch in batches:
            part, slices, data, dk, tk, texts = (batch.column(i).to_pylist() for i in range(6))
            at = 0
            while at < len(part):
                if part[at] != now:
                    now, cells, known = part[at], [], None
                if slices[at] is not None:
                    cells.append(unpacked(data[at]) + slices[at] * (DEPTH << bits))
                    at += 1
                    continue
                if known is None:
                    known, cells = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.int64), []
                end = at
                while end < len(part) and part[end] == now and slices[end] is None:
                    end += 1
                yield from dealt(dealer, dk[at:end], tk[at:end], texts[at:end], known)
                at = end
        yield from dealer.flush()

    def dealt(dealer, dk, tk, texts, known):
        number: dict[int, int] = {}
        for lanes, sizes, docs, bases in blocks(texts, width):
            runs = R.runs_of(lanes[:, 0], sizes, width, gram)
            starts = np.cumsum(sizes) - sizes
            slices = R.bucket_of(runs.anchor, n_buckets).astype(np.int64) * (DEPTH << bits)
            use = np.ones(len(runs.anchor), bool)
            for row in cells_of(runs.anchor, bits):
                use &= R.is_in(known, slices + row)
            if use.any():
                many = runs.many[use]
                window = R.ragged(runs.first[use], many)
                keys = [R.grams(np.ascontiguousarray(lanes[:, i]), width)[window] for i in (0, 1)]
                chunk = np.repeat(runs.chunk[use], many)
                anchor = np.repeat(runs.anchor[use], many)
                for i in set(docs[runs.chunk[use]].tolist()):
                    if i not in number:
                        number[i] = dealer.document(dk[i], tk[i])
                doc = np.array([number.get(i, -1) for i in docs.tolist()])[chunk]
                dealer.add(keys, doc, window - starts[chunk] + bases[chunk], np.where(R.is_in(hot, anchor), keys[0], anchor))
            if dealer.held > R.FLUSH:
                yield from dealer.flush()
                number = {}
        if dealer.held > R.FLUSH // 2 or len(dealer.docs) > 200_000:
            yield from dealer.flush()

    none = lambda kind: F.lit(None).cast(kind)
    texts = base.select(F.pmod(F.hash("dk", "tk"), F.lit(n_buckets)).alias("part"), none("int").alias("slice"), none("binary").alias("cells"), "dk", "tk", "text")
    heard = told(base, bits, width, gram).select("part", "slice", "cells", none("long").alias("dk"), none("long").alias("tk"), none("string").alias("text"))
    rows = texts.unionByName(heard).repartitionById(n_buckets, F.col("part")).sortWithinPartitions("part", F.col("slice").isNull())
    return R.repeated_places(rows.mapInArrow(deal, R.PACKED), 2, n_buckets)


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id n_words n_removed kept`` (kept words joined by one space)."""
    # The same three columns everywhere, so that both joins read one exchange of the texts.
    base = R.identified(docs, id_col, text_col).select("dk", "tk", "text")
    found = R.gathered(repeated_windows(base, width=width, gram=(width + 1) // 2), partitions(docs.sparkSession))

    def remove(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                spans, gone = R.read_spans(places), 0
                kept = words
                if len(spans):
                    cover = R.covered(spans, width, len(words))
                    gone = int(cover.sum())
                    kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                for column, value in zip(out, (None if key == -(2**63) else key, len(words), gone, b" ".join(kept).decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    joined = parted(base).drop("part").join(found.hint("shuffle_hash"), ["dk", "tk"], "left").select("dk", "text", "places")
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM w WHERE len(w) >= {WIDTH})),
hit AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + {WIDTH})) AS j FROM hit) GROUP BY doc_id),
pos AS (SELECT w.doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
kept AS (SELECT pos.doc_id, string_agg(pos.w[pos.i], ' ' ORDER BY pos.i) AS k FROM pos LEFT JOIN gone USING (doc_id) WHERE g IS NULL OR NOT list_contains(g, pos.i) GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": SQL}
