"""Exact removal of repeated byte strings with distributed deep-shallow suffix sorting.

A byte is removed when a string of ``width`` bytes that covers it also starts earlier: in a document of smaller
id, or earlier in the same document. Strings are judged on the input and stay within a document.

Three steps, each dealt by content. (1) Every string has an anchor (see ``repeats``); anchors that occur once
in the corpus rule out the strings that have them. (2) For the other anchors the stretch of text under their
strings is sent to the bucket of the anchor, which sorts the suffixes that start there by ``width`` bytes
(``deep_shallow``); neighbours that agree in all of them are equal strings, and all but the earliest are
removed. Stretches with equal text are one stretch: only the earliest is sorted and the others are removed; equal
hashes find them and their bytes are compared. (3) Spans go back to their documents.

Anchors that have a large share of a bucket are found on a sample; they need no counting, and their strings are
dealt one by one, each by all of its bytes. Equal stretches are united in each task before they are sent, so copies load no bucket.

Defined cases: a null text is empty; texts shorter than ``width`` bytes keep all; rows equal in id and text are
one document and get the same answer; rows of one id with different texts are ordered by a hash of the text; a
null id comes first; an empty table gives an empty result; extra columns are ignored. Long texts are read whole,
in chunks that overlap by a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import repeats as R
from tideline.llm.common import partitions, table
from tideline.llm.deep_shallow import sort_suffixes

WIDTH, GRAM = 100, 40
CHUNK = BLOCK = 1 << 20
#: Bytes of stretches that a task holds before it passes them on.
HELD = 16 << 20
#: Bytes compared at a time.
VERIFIED = 1 << 20
SYMBOLS = [R.mix(np.arange(1, 257, dtype=np.uint64), s) for s in (3, 5)]
STRETCHES = "bucket int, meta binary, data binary, known binary"


def blocks(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole chunks: (bytes, chunk sizes, document of each chunk, its first byte in the document)."""
    held: list[bytes] = []
    docs: list[int] = []
    bases: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        raw = text.encode()
        for base in range(0, len(raw) - width + 1, CHUNK):
            held.append(raw[base : base + CHUNK + width - 1])
            docs.append(i)
            bases.append(base)
            size += len(held[-1])
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.array([len(h) for h in held]), np.array(docs), np.array(bases)
                held, docs, bases, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array([len(h) for h in held]), np.array(docs), np.array(bases)


def repeated_anchors(base: DataFrame, hot, width: int, gram: int) -> DataFrame:
    """``dk tk places``: the places of anchors that occur more than once, without those in ``hot``."""
    n_buckets = partitions(base.sparkSession)

    def deal(batches):
        dealer = R.Dealer(n_buckets, 1)
        for batch in batches:
            dk, tk, texts = (batch.column(i).to_pylist() for i in range(3))
            offset = len(dealer.docs)
            dealer.docs.extend(zip(dk, tk, strict=True))
            for raw, sizes, docs, bases in blocks(texts, width):
                runs = R.runs_of(SYMBOLS[0][raw], sizes, width, gram)
                rare = ~R.is_in(hot.value, runs.anchor)
                anchor, at, chunk = runs.anchor[rare], runs.at[rare], runs.chunk[rare]
                starts = np.cumsum(sizes) - sizes
                dealer.add([anchor], docs[chunk] + offset, at - starts[chunk] + bases[chunk], anchor)
            if dealer.held > R.FLUSH:
                yield from dealer.flush()
        yield from dealer.flush()

    return R.repeated_places(base.mapInArrow(deal, R.PACKED), 1, n_buckets)


def range_hashes(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = R.POWERS.upto(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return R.mix((total[first + size] - total[first]) * down[first])


def in_others(again: np.ndarray, *ids: np.ndarray) -> np.ndarray:
    """Of sorted rows, those equal to the one before (``again``) whose ``ids`` differ from the first equal row's:
    a repeated row of a document sends what the document sent already, and that is no string before it."""
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    return again & np.any([x != x[first] for x in ids], axis=0)


def pieces_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[R.ragged(first, size)]


def same_text(again: np.ndarray, order: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of rows in ``order`` that agree in their hashes with the one before (``again``), those that agree in all bytes."""
    rows = np.flatnonzero(again)
    total = np.cumsum(size[order[rows]])
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + VERIFIED, "right")))
        this, last = order[rows[a:b]], order[rows[a:b] - 1]
        equal = pieces_of(data, at[this], size[this]) == pieces_of(data, at[last], size[last])
        again[rows[a:b]] = np.logical_and.reduceat(equal, np.cumsum(size[this]) - size[this])
        a = b
    return again


class Stretches:
    """Gathers stretches of a task, unites equal ones and packs the rest per bucket."""

    def __init__(self, n_buckets: int, width: int):
        self.n, self.width, self.turn = n_buckets, width, 0
        self._clear()

    def _clear(self) -> None:
        self.meta, self.data, self.held = [], [], 0

    def add(self, raw: np.ndarray, anchor: np.ndarray, dk: np.ndarray, tk: np.ndarray, pos: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        size = many + self.width - 1
        hashes = [range_hashes(s[raw], first, size) for s in SYMBOLS]
        self.meta.append((anchor, dk, tk, pos, many, *hashes))
        self.data.append(pieces_of(raw, first, size))
        self.held += len(self.data[-1])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.meta:
            anchor, dk, tk, pos, many, one, two = (np.concatenate(x) for x in zip(*self.meta, strict=True))
            data = np.concatenate(self.data)
            size = many + self.width - 1
            at = np.cumsum(size) - size
            order = np.lexsort((pos, tk, dk, many, two, one, anchor))
            again = same_text(R.same_as_before([x[order] for x in (anchor, one, two, many)]), order, data, at, size)
            keep, known = np.sort(order[~again]), order[in_others(again, *(x[order] for x in (dk, tk, pos)))]
            self.turn += 1
            away = (R.mix(tk[known].view(np.uint64), self.turn) % np.uint64(self.n)).astype(np.int32)
            bucket = R.bucket_of(anchor[keep], self.n)
            keep, bucket = keep[by := np.argsort(bucket, kind="stable")], bucket[by]
            known, away = known[by := np.argsort(away, kind="stable")], away[by]
            rows: list[list] = [[], [], [], []]
            for b in np.union1d(bucket, away):
                k = keep[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, "right")]
                w = known[np.searchsorted(away, b) : np.searchsorted(away, b, "right")]
                meta = np.stack([anchor[k].view(np.int64), dk[k], tk[k], pos[k], many[k]]).tobytes()
                told = np.stack([dk[w], tk[w], pos[w], many[w]]).tobytes()
                for column, value in zip(rows, (int(b), meta, pieces_of(data, at[k], size[k]).tobytes(), told), strict=True):
                    column.append(value)
                if len(rows[0]) >= 64:
                    yield self._batch(rows)
                    rows = [[], [], [], []]
            yield self._batch(rows)
        self._clear()

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "meta", "data", "known"])


def later_strings(stretches: DataFrame, n_buckets: int, width: int) -> DataFrame:
    """``dk tk places``: spans of strings that also start earlier, from the sorted suffixes of each bucket."""

    def settle(batches):
        metas, datas, told = [], [], []
        for batch in batches:
            for meta, data, known in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                metas.append(np.frombuffer(meta.as_buffer(), np.int64).reshape(5, -1))
                datas.append(np.frombuffer(data.as_buffer(), np.uint8))
                told.append(np.frombuffer(known.as_buffer(), np.int64).reshape(4, -1))
        if not metas:
            return
        anchor, dk, tk, pos, many = np.concatenate(metas, axis=1)
        data, out = np.concatenate(datas), [np.concatenate(told, axis=1)]
        del datas, metas, told
        size = many + width - 1
        at = np.cumsum(size) - size
        hashes = np.zeros((2, len(size)), np.uint64)
        for a in range(0, len(size), 8192):
            b = min(a + 8192, len(size))
            part = data[at[a] : at[b - 1] + size[b - 1]]
            for i, s in enumerate(SYMBOLS):
                hashes[i, a:b] = range_hashes(s[part], at[a:b] - at[a], size[a:b])
        order = np.lexsort((pos, tk, dk, many, hashes[1], hashes[0], anchor))
        again = same_text(R.same_as_before([x[order] for x in (anchor, hashes[0], hashes[1], many)]), order, data, at, size)
        gone = order[in_others(again, *(x[order] for x in (dk, tk, pos)))]
        out.append(np.stack([dk[gone], tk[gone], pos[gone], many[gone]]))
        left = order[~again]  # sorted by anchor: an anchor with one stretch left needs no sorting
        same = R.same_as_before([anchor[left]])
        left = left[same | np.append(same[1:], False)]
        for part in _portions(anchor[left], many[left]):
            seg = left[part]
            text = np.append(pieces_of(data, at[seg], size[seg]), np.zeros(8, np.uint8))
            start = np.cumsum(size[seg]) - size[seg]
            suffix = R.ragged(start, many[seg])
            of = np.repeat(seg, many[seg])
            place = pos[of] + suffix - np.repeat(start, many[seg])
            order, new = sort_suffixes(text, suffix, width)
            equal = np.cumsum(new)
            rank = np.lexsort((place[order], tk[of[order]], dk[of[order]], equal))
            by = order[rank]
            later = by[in_others(R.same_as_before([equal[rank]]), dk[of[by]], tk[of[by]], place[by])]
            out.append(np.stack([dk[of[later]], tk[of[later]], place[later], np.ones(len(later), np.int64)]))
        yield from R.spans_by_bucket(*np.concatenate(out, axis=1), n_buckets)

    return stretches.repartitionById(n_buckets, F.col("bucket")).mapInArrow(settle, R.PLACES)


#: Suffixes sorted at a time; an anchor's are never parted.
PORTION = 500_000


def _portions(anchor: np.ndarray, many: np.ndarray) -> Iterator[slice]:
    a, total = 0, np.cumsum(many)
    while a < len(anchor):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + PORTION, "right"))
        b = max(b, a + 1)
        while b < len(anchor) and anchor[b] == anchor[b - 1]:
            b += 1
        yield slice(a, b)
        a = b


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id n_bytes n_removed spans kept``; spans are (start, length) of removed
    bytes and ``kept`` are the remaining ones."""
    spark = docs.sparkSession
    # The same three columns everywhere, so that both joins read one exchange of the texts.
    base = R.identified(docs, id_col, text_col).select("dk", "tk", "text")
    n_buckets = partitions(spark)

    def anchors_of(texts):
        found = [R.runs_of(SYMBOLS[0][raw], sizes, width, gram).anchor for raw, sizes, _, _ in blocks(texts, width)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    hot = spark.sparkContext.broadcast(R.hot_anchors(base, anchors_of, n_buckets))
    any_hot = len(hot.value) > 0
    marks = R.gathered(repeated_anchors(base, hot, width, gram), n_buckets)

    def send(batches):
        out = Stretches(n_buckets, width)
        for batch in batches:
            dk, tk = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            texts, places = batch.column(2).to_pylist(), [R.read_spans(p) for p in batch.column(3).to_pylist()]
            if not any_hot:
                texts = [t if len(p) else "" for t, p in zip(texts, places, strict=True)]
            for raw, sizes, docs_, bases in blocks(texts, width):
                starts = np.cumsum(sizes) - sizes
                marked = R.marked(places, docs_, bases, starts, sizes)
                symbols = SYMBOLS[0][raw]
                runs = R.runs_of(symbols, sizes, width, gram)
                common = R.is_in(hot.value, runs.anchor)
                use = marked[runs.at] & ~common
                anchor, first, many, chunk = runs.anchor[use], runs.first[use], runs.many[use], runs.chunk[use]
                if common.any():  # their strings one by one, each by its own content
                    each = R.ragged(runs.first[common], runs.many[common])
                    anchor = np.concatenate([anchor, R.grams(symbols, width)[each]])
                    first, many = np.concatenate([first, each]), np.concatenate([many, np.ones(len(each), np.int64)])
                    chunk = np.concatenate([chunk, np.repeat(runs.chunk[common], runs.many[common])])
                if len(first):
                    doc = docs_[chunk]
                    out.add(raw, anchor, dk[doc], tk[doc], first - starts[chunk] + bases[chunk], first, many)
                if out.held > HELD:
                    yield from out.flush()
        yield from out.flush()

    texts = base.join(marks.hint("shuffle_hash"), ["dk", "tk"], "left")
    found = R.gathered(later_strings(texts.select("dk", "tk", "text", "places").mapInArrow(send, STRETCHES), n_buckets, width), n_buckets)

    def remove(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, spans, removed = text.encode(), R.read_spans(places), []
                kept = raw
                if len(spans):
                    cover = R.covered(spans, width, len(raw))
                    edge = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
                    removed = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                for column, value in zip(out, (None if key == -(2**63) else key, len(raw), len(raw) - len(kept), removed, kept), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return base.join(found.hint("shuffle_hash"), ["dk", "tk"], "left").select("dk", "text", "places").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_array_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
ORACLES: dict[str, str] = {}
