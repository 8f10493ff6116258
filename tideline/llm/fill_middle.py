"""Fill-in-middle: a text cut at two token borders, with its parts put in another order behind sentinels.

The borders of a block of texts are one bit per byte, packed into 64-bit words. A directory holds the set bits before
each block of eight words, a second one those before each word inside its block: ``rank`` adds the two and the popcount
of a partial word, ``select`` searches the directory, then the block, then the word. A text's total popcount is its
number of tokens ``n``, and ``select`` on two drawn ranks gives the byte cuts. A second vector marks the bytes that
begin a character, so that the lengths of the parts in code points are ranks, too. Draws depend on seed and id alone.

Defined cases: a null text is an empty one; an empty text, and one with a sentinel of ours in it, stay plain; a null id
draws as an empty one; repeated rows draw alike; an empty table gives an empty result; texts are cut whole, whatever
their length; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: Bytes of text that a task turns into bit vectors at a time (a longer text is a block of its own).
BLOCK = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Of each byte: does it separate words?
SEPARATES = np.zeros(256, bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True


class BitVector:
    """Bits with ``rank`` and ``select`` over packed words and popcount directories."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-(len(packed) + 1) // 64) * 64, np.uint8)  # whole blocks, and a bit past the end to rank
        words[: len(packed)] = packed
        self.words = words.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, 8)
        self.inner = np.cumsum(counts, axis=1) - counts  # set bits of the block before each of its words
        totals = counts.sum(axis=1)
        self.directory = np.cumsum(totals) - totals  # set bits before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before the positions ``at``."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.directory[at >> 9] + self.inner.reshape(-1)[word] + np.bitwise_count(below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the ``k``-th set bits, counted from 1."""
        block = np.searchsorted(self.directory, k, side="left") - 1
        left = k - self.directory[block]
        word = (self.inner[block] < left[:, None]).sum(axis=1) - 1
        left -= self.inner[block, word]
        bits = np.unpackbits(self.words[block * 8 + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * 8 + word) * 64 + (np.cumsum(bits, axis=1) < left[:, None]).sum(axis=1)


def borders(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bit for each byte that ends a token: a word with the white space before it, or white space at a text's end."""
    blank = SEPARATES[data]
    bits = np.zeros(len(data), bool)
    bits[:-1] = ~blank[:-1] & blank[1:]
    bits[ends - 1] = True
    return bits


def _blocks(texts: list[bytes]):
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def rearranged(keys: list[int | None], texts: list[bytes], seed: int = SEED, rate: int = RATE, spm: int = SPM) -> list[tuple]:
    """``(n, form, prefix_chars, middle_chars, output)`` of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    tokens = BitVector(borders(data, ends[lengths > 0]) if len(data) else np.zeros(0, bool))
    chars = BitVector((data & 0xC0) != 0x80)
    first = tokens.rank(starts)
    counts = tokens.rank(ends) - first
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    forms, ranks = [], np.zeros((len(texts), 2), np.int64)
    for i, (key, text, n) in enumerate(zip(keys, texts, counts.tolist(), strict=True)):
        digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[4 * j : 4 * j + 4], "big") for j in range(4))
        plain = not text or h3 % 100 >= rate or any(s in text for s in sentinels)
        forms.append("plain" if plain else "spm" if h4 % 100 < spm else "psm")
        ranks[i] = sorted((h1 % (n + 1), h2 % (n + 1)))
    cuts = np.repeat(starts[:, None], 2, axis=1)
    chosen = ranks > 0
    cuts[chosen] = tokens.select((first[:, None] + ranks)[chosen]) + 1
    begun = chars.rank(np.column_stack([starts, cuts]).reshape(-1)).reshape(-1, 3)
    sizes = np.diff(begun, axis=1).tolist()
    p, s, m = sentinels
    out = []
    for text, form, n, (a, b), (n_prefix, n_middle) in zip(texts, forms, counts.tolist(), (cuts - starts[:, None]).tolist(), sizes, strict=True):
        if form == "plain":
            out.append((n, form, None, None, text))
        elif form == "psm":
            out.append((n, form, n_prefix, n_middle, b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
        else:
            out.append((n, form, n_prefix, n_middle, b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id n form prefix_chars middle_chars output``. Of 100 documents ``rate`` are rearranged,
    and of 100 of those ``spm`` have the suffix first."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for at, block in _blocks(texts):
                rows = rearranged(keys[at : at + len(block)], block, seed, rate, spm)
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + len(block)], pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form alone. A rearranged text holds no sentinel of its own, and none can arise
    where a part meets one, as ``<`` stands only at their front."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, us, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid, coalesce(array_to_string(us[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": SQL}
