"""Finding windows of symbols (bytes or words) that start more than once in a corpus.

Every window of ``width`` symbols has an anchor: the ``gram``-symbol string inside it whose hash is smallest,
leftmost on ties. Equal windows have equal anchors at equal places, so windows only need to meet within their
anchor, and consecutive windows share one. A *run* is a maximal stretch of windows with the same anchor.

Items (a key, and a place in a document) are dealt to buckets in packed rows, one row per task and bucket, and
grouped there; what comes back is packed places per bucket of documents. An anchor that has a large share of a
bucket's items would load it: a sample finds such anchors (at most ``SHARES`` per bucket), and their windows are
dealt one by one, by their own content. The sample only decides the way rows take, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import written

BASE = 0x9E3779B97F4A7C15
INDEX_BITS = 22
INDEX = np.uint64((1 << INDEX_BITS) - 1)
#: Items that a task packs at a time.
FLUSH = 600_000
SAMPLE = 0.01
#: Occurrences of an anchor, and the share of an average bucket (one of so many), from which it counts as hot.
HOT, SHARES = 20_000, 8
PACKED = "bucket int, docs binary, lanes binary, pos binary, flag binary"
PLACES = "bucket int, spans binary"


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id dk tk text``: (dk, tk) tells documents apart; rows with equal id and text are one document."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(-(2**63))).alias("dk"), F.xxhash64(text).alias("tk"), text.alias("text"))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` symbols."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


@dataclass
class Runs:
    """Runs of a block: hash and place of the anchor, first window, number of windows, chunk."""

    anchor: np.ndarray
    at: np.ndarray
    first: np.ndarray
    many: np.ndarray
    chunk: np.ndarray


def runs_of(symbols: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> Runs:
    """``sizes`` are the lengths of the chunks that ``symbols`` concatenates; windows stay inside a chunk."""
    none = np.zeros(0, np.int64)
    if len(symbols) < width:
        return Runs(none.view(np.uint64), none, none, none, none)
    hashes = grams(symbols, gram)
    keyed = (hashes & ~INDEX) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_min(keyed, width - gram + 1) & INDEX).astype(np.int64)
    ends = np.cumsum(sizes)
    chunk = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= ends[chunk])
    if not len(start):
        return Runs(none.view(np.uint64), none, none, none, none)
    at = least[start]
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return Runs(hashes[at[begins]], at[begins], start[begins], np.diff(np.append(begins, len(start))), chunk[start[begins]])


def ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (many[0] of them), first[1], ..."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(first, many)


def same_as_before(columns: list[np.ndarray]) -> np.ndarray:
    same = np.ones(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    return np.concatenate([[False], same]) if len(columns[0]) else np.zeros(0, bool)


def bucket_of(route: np.ndarray, n: int) -> np.ndarray:
    return (mix(route, 7) % np.uint64(n)).astype(np.int32)


class Dealer:
    """Gathers items of a task and packs them per bucket. An item is a key of one or more 64-bit lanes, the
    document and the place where it starts, and a route. Items whose key occurs twice within the task are known
    to repeat: the first is sent for others to see (flag 2), and all go back with no key (flag 1) by way of a
    bucket that doesn't depend on the key, so a key in very many documents loads no bucket."""

    def __init__(self, n_buckets: int, lanes: int):
        self.n, self.lanes, self.turn = n_buckets, lanes, 0
        self._clear()

    def _clear(self) -> None:
        self.held, self.docs, self.items = 0, [], []

    def document(self, dk: int, tk: int) -> int:
        self.docs.append((dk, tk))
        return len(self.docs) - 1

    def add(self, keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, route: np.ndarray) -> None:
        self.items.append((*keys, doc.astype(np.int64), pos.astype(np.int64), route))
        self.held += len(doc)

    def flush(self) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*self.items, strict=True)] if self.items else []
        if columns and len(columns[0]):
            yield from self._rows(columns)
        self._clear()

    def _rows(self, columns) -> Iterator[pa.RecordBatch]:
        *keys, doc, pos, route = columns
        order = np.lexsort((pos, doc, *keys))
        keys, doc, pos, route = [k[order] for k in keys], doc[order], pos[order], route[order]
        again = same_as_before(keys)
        twice = again | np.append(again[1:], False)
        bucket = bucket_of(route, self.n)
        single = ~twice
        first = twice & ~again
        self.turn += 1
        away = ((mix(doc.astype(np.uint64), self.turn)) % np.uint64(self.n)).astype(np.int32)
        part = [
            (bucket[single], [k[single] for k in keys], doc[single], pos[single], np.zeros(single.sum(), np.uint8)),
            (bucket[first], [k[first] for k in keys], doc[first], pos[first], np.full(first.sum(), 2, np.uint8)),
            (away[twice], [np.zeros(twice.sum(), np.uint64) for k in keys], doc[twice], pos[twice], np.ones(twice.sum(), np.uint8)),
        ]
        bucket, doc, pos, flag = (np.concatenate([p[i] for p in part]) for i in (0, 2, 3, 4))
        keys = [np.concatenate([p[1][j] for p in part]) for j in range(self.lanes)]
        order = np.lexsort((pos, doc, flag, bucket))
        bucket, doc, pos, flag, keys = bucket[order], doc[order], pos[order], flag[order], [k[order] for k in keys]
        docs = np.array(self.docs, np.int64).reshape(-1, 2)
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d, p, f = doc[a:b], pos[a:b], flag[a:b]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
            heads = np.empty((len(new), 3), np.int64)
            heads[:, :2], heads[:, 2] = docs[d[new]], np.diff(np.append(new, b - a))
            step = np.diff(p, prepend=0)
            step[new] = p[new]
            sent = f != 1
            for column, value in zip(rows, (int(bucket[a]), heads.T.tobytes(), np.stack([k[a:b][sent] for k in keys]).tobytes(), step.astype("<i4" if p.max() < 2**31 else "<i8").tobytes(), f.tobytes()), strict=True):
                column.append(value)
        for at in range(0, len(rows[0]), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 256], t) for c, t in zip(rows, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "docs", "lanes", "pos", "flag"])


def unpacked_row(docs, lane, pos, flag, lanes: int):
    """Items of a row: (dk, tk, keys, pos, flag); keys of flag 1 are absent."""
    head = np.frombuffer(docs.as_buffer(), np.int64).reshape(3, -1)
    flag = np.frombuffer(flag.as_buffer(), np.uint8)
    raw = pos.as_buffer()
    step = np.frombuffer(raw, "<i4" if raw.size == 4 * len(flag) else "<i8").astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(head[2]) - head[2]
    place = total - np.repeat(total[starts] - step[starts], head[2])
    return np.repeat(head[0], head[2]), np.repeat(head[1], head[2]), np.frombuffer(lane.as_buffer(), np.uint64).reshape(lanes, -1), place, flag


def unpacked(batches, lanes: int):
    """All items of a bucket's rows: (dk, tk, keys, pos, flag); keys of flag 1 are absent."""
    rows = [unpacked_row(*row, lanes) for batch in batches for row in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True)]
    if not rows:
        return None
    return tuple(np.concatenate(x, axis=-1) for x in zip(*rows, strict=True))


def joined_spans(dk: np.ndarray, tk: np.ndarray, first: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Spans (first, number) of documents in order; touching ones are joined."""
    order = np.lexsort((first, tk, dk))
    dk, tk, first, many = dk[order], tk[order], first[order], many[order]
    if not len(dk):
        return [dk, tk, first, many]
    # A span may end inside an earlier, longer one: what counts is the furthest end so far in the document.
    new_doc = np.concatenate([[True], (dk[1:] != dk[:-1]) | (tk[1:] != tk[:-1])])
    number = np.cumsum(new_doc) - 1
    base = number * (int((first + many).max()) + 1)
    end = np.maximum.accumulate(first + many + base)
    start = np.flatnonzero(np.concatenate([[True], (first + base)[1:] > end[:-1]]) | new_doc)
    last = np.append(start[1:], len(dk)) - 1
    return [dk[start], tk[start], first[start], end[last] - base[last] - first[start]]


def spans_by_bucket(dk: np.ndarray, tk: np.ndarray, first: np.ndarray, many: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PLACES``: the spans of the documents of a bucket, packed."""
    dk, tk, first, many = joined_spans(dk, tk, first, many)
    if not len(dk):
        return
    bucket = bucket_of(dk.view(np.uint64) ^ tk.view(np.uint64), n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], np.stack([dk[order], tk[order], first[order], many[order]])
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    blobs = [np.ascontiguousarray(rows[:, a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for at in range(0, len(blobs), 256):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]][at : at + 256]), pa.array(blobs[at : at + 256], pa.binary())], ["bucket", "spans"])


def gathered(places: DataFrame, n_buckets: int) -> DataFrame:
    """``dk tk places``: a row per document with all its spans."""

    def run(batches):
        blobs = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for batch in batches for x in batch.column(1)]
        if not blobs:
            return
        dk, tk, first, many = joined_spans(*np.concatenate(blobs, axis=1))
        edges = np.append(np.flatnonzero(np.concatenate([[True], (dk[1:] != dk[:-1]) | (tk[1:] != tk[:-1])])), len(dk))
        span = np.stack([first, many], axis=1)
        for at in range(0, len(edges) - 1, 5000):
            part = edges[at : at + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(dk[part[:-1]]), pa.array(tk[part[:-1]]), pa.array([span[a:b].tobytes() for a, b in zip(part[:-1], part[1:], strict=True)], pa.binary())], ["dk", "tk", "places"])

    return places.repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, "dk long, tk long, places binary")


def read_spans(places: bytes | None) -> np.ndarray:
    """(first, number) rows of ``places``."""
    return np.frombuffer(places or b"", np.int64).reshape(-1, 2)


def marked(places: list[np.ndarray], docs: np.ndarray, bases: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which symbols of a block are at one of the ``places`` (spans of each document)."""
    out = np.zeros(int(sizes.sum()), bool)
    for d, b, s, n in zip(docs.tolist(), bases.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        spot = ragged(places[d][:, 0], places[d][:, 1]) - b
        out[s + spot[(spot >= 0) & (spot < n)]] = True
    return out


def covered(spans: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols are inside a window that starts in one of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, np.minimum(spans.sum(axis=1) + width - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_places(packed: DataFrame, lanes: int, n_buckets: int) -> DataFrame:
    """From ``PACKED`` rows the places whose key occurs at least twice, as ``PLACES`` rows: a row per two buckets at most, so their number doesn't follow that of the documents."""

    def settle(batches):
        got = unpacked(batches, lanes)
        if got is None:
            return
        dk, tk, keys, pos, flag = got
        sent = np.flatnonzero(flag != 1)
        order = np.lexsort(tuple(keys))
        again = same_as_before([k[order] for k in keys])
        twice = again | np.append(again[1:], False) if len(again) else again
        hit = sent[order[twice]]
        # Places of a key with flag 2 came with flag 1 from the same task.
        hit = np.concatenate([hit[flag[hit] == 0], np.flatnonzero(flag == 1)])
        yield from spans_by_bucket(dk[hit], tk[hit], pos[hit], np.ones(len(hit), np.int64), n_buckets)

    return packed.repartitionById(n_buckets, F.col("bucket")).mapInArrow(settle, PLACES)


def hot_anchors(base: DataFrame, anchors_of: Callable[[list[str]], np.ndarray], n_buckets: int, fraction: float = SAMPLE, hot: int = HOT) -> np.ndarray:
    """Sorted hashes of anchors that a sample of documents shows to occur more than about ``hot`` times and to have
    a ``SHARES``-th of an average bucket: at most ``SHARES * n_buckets`` of them, 8 bytes each."""

    def run(batches):
        for batch in batches:
            found, n = np.unique(anchors_of(batch.column(0).to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    seen = base.sample(fraction, seed=1).select("text").mapInArrow(run, "anchor long, n long")
    seen = written(seen.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    total = seen.agg(F.sum("n")).first()[0] or 0
    got = seen.filter(F.col("n") >= max(hot * fraction, total / (SHARES * n_buckets))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in got], np.int64).view(np.uint64))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x
