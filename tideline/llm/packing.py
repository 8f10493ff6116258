"""Best-fit packing of token sequences, planned over a histogram of lengths.

``tokenize`` turns each text into pieces of at most ``capacity`` tokens (only longer documents are cut);
``plan_slots`` runs best-fit decreasing over *counts per length* and returns runs of slots; ``pack`` ranks the
pieces within each length and joins them to the planned runs. The histogram has at most ``capacity`` rows and
the plan is a function of it alone, so what reaches the driver is bounded by ``capacity``, not by the corpus.

Ranks are made without gathering a length in one task: pieces are dealt by (length, salt), numbered within
that, and shifted by the summed counts of the smaller salts, so a length that a third of all pieces share is
spread over as many tasks as there are salts.

Defined cases: a null or empty text is the end token alone; repeated rows and null ids are packed like any
other row (equal rows take different slots); an empty table gives an empty result; a text is cut, never
truncated, whatever its length; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tideline.llm.common import partitions, table, written

CAPACITY = 4096
END_ID = 1
#: Words that a task remembers the ids of, and the bytes of the longest of them: at most about 250 MB.
REMEMBERED, LONGEST = 500_000, 48
#: A plan up to so many runs (40 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_RUNS = 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The characters that stand for bytes which don't print, in byte-level vocabularies.
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def latin(text: str) -> bool:
    """Letters below U+0250 only: composed already, and with lower cases of one letter."""
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes. The vocabulary drops white space before it
    splits further, so the ids of a text are those of its words in order. It also lowers case and splits
    punctuation from letters and digits, so ``Word,`` has the ids of ``word`` and of the comma: only roots are
    encoded. Short roots and words are remembered up to a number, and then forgotten; long ones are encoded each time."""

    def __init__(self, vocab: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.roots, self.remembered = Tokenizer.from_file(vocab), {}, remembered
        self.model = self.tokenizer.model
        self.tails = {t: self._encoded(t.decode()) for t in (b".", b",")}

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, text: str) -> bytes:
        """Of one run of lower-case letters, in the characters of the vocabulary: nothing is left to split."""
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        tail = self.tails.get(word[-1:])
        if word.isascii():
            root = word.lower()
            if tail and root[-2:-1].isalnum():
                root = root[:-1]
            else:
                tail = None
        else:
            text = word.decode()
            if tail and latin(text[:-1]):
                text = text[:-1]
            else:
                tail = None
            root = text.lower().encode() if latin(text) else text.encode()
        ids = self.roots.get(root)
        short = len(word) <= LONGEST
        if ids is None:
            if root.isalpha():
                ids = self._letters(root.decode())
            elif latin(text := root.decode()):
                ids = self._letters(root.decode("latin-1").translate(BYTE_CHARS))
            else:
                ids = self._encoded(text)
            if len(self.roots) >= self.remembered:
                self.roots.clear()
            if short:
                self.roots[root] = ids
        if tail:
            ids += tail
        if len(self) >= self.remembered:
            self.clear()
        if short:
            self[word] = ids
        return ids

    def __call__(self, texts: list[bytes], end: bytes) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.split())) + end for t in texts]


#: A worker keeps what it has learnt for the tasks that follow.
LEARNT: dict[str, WordIds] = {}


def _blocks(texts: list[str | None], most: int):
    """Consecutive texts of about ``most`` bytes together."""
    at, size, block = 0, 0, []
    for i, text in enumerate(texts):
        block.append((text or "").encode())
        size += len(block[-1])
        if size >= most or i + 1 == len(texts):
            yield at, block
            at, size, block = i + 1, 0, []


def tokenize(docs: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``doc_id piece start length ids_crc32``."""

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocab not in LEARNT:
            LEARNT[vocab] = WordIds(vocab)
        ids_of, end = LEARNT[vocab], np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = ([], [], [], [], [])
            for at, block in _blocks(texts, 1 << 20):
                for key, ids in zip(keys[at:], ids_of(block, end), strict=False):
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        for column, value in zip(out, (key, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Each run ``(length, rank, n, sequence, offset)`` gives the pieces of
    ranks rank .. rank+n-1 within their length the sequences sequence .. sequence+n-1, all at one offset."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges of sequences
    free: list[int] = []  # its keys, in order
    runs, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
                take = min(n, todo)
                runs.append((length, rank, take, first, capacity - left))
                put(left, first + take, n - take)
                put(left - length, first, take)
                rank, todo = rank + take, todo - take
                continue
            each = capacity // length  # best fit fills an opened sequence with equal pieces first
            full, rest = divmod(todo, each)
            for k in range(each if full else 0):
                runs.append((length, rank + k * full, full, opened, k * length))
            put(capacity - each * length, opened, full)
            for k in range(rest):
                runs.append((length, rank + each * full + k, 1, opened + full, k * length))
            put(capacity - rest * length, opened + full, 1 if rest else 0)
            opened, todo = opened + full + (1 if rest else 0), 0
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark, salts = pieces.sparkSession, max(16, partitions(pieces.sparkSession))
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sized = pieces.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    before = sized.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("__local", local).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__local") - 1)
    runs = plan_slots(counts, capacity)
    plan = spark.createDataFrame(runs, "length long, __first long, __many long, __seq long, __at long")
    on = (ranked["length"] == plan["length"]) & (ranked["__rank"] >= plan["__first"]) & (ranked["__rank"] < plan["__first"] + plan["__many"])
    joined = ranked.join(F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan, on).drop(plan["length"])
    return joined.withColumns({"sequence_id": F.col("__seq") + F.col("__rank") - F.col("__first"), "offset": F.col("__at")}).drop("__salt", "__local", "__before", "__rank", "__first", "__many", "__seq", "__at")


def packed(docs: DataFrame, vocab: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = written(tokenize(docs, vocab, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs.select("doc_id", "text"), vocabulary())


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
