"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the whole corpus.

Every byte of a text gets a label: no token ends there, one of A, one of B, or one of both. A regular expression scans
the labels for the spans up to each both-label; the labels of a span count its tokens of A and of B and so cut both id
sequences into groups. Within a group no inner end is shared, so each labelled byte ends exactly one stretch that one A
token and one B token cover: those stretches are the links.

Both tokenizers split before white space that follows a word (checked against B's vocabulary when it is read), so texts
are taken apart there and a task labels each distinct unit once while it remembers it. A text with other white space at
such a place stays whole there, and one that B does not spell back unit by unit is judged as a whole.

Links are counted per document first. Id pairs are summed over the corpus; those above a count that at most ``COMMON``
pairs reach are broadcast, the others meet their documents by a shuffle, so no pair that every text holds is a hot key.

Defined cases: null and empty texts, and texts that the tokens of A or B don't spell back (a U+2581 of their own), have
no tokens: zeros and an empty ``groups``; repeated rows count each; null ids are kept; an empty table gives an empty
result; texts are read whole, whatever their length; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tideline.llm.common import table, written

#: Units that a task remembers (about 500 bytes each), and the characters of the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of text that a task labels at a time (a longer text is a block of its own).
BLOCK = 1 << 20
#: At most so many id pairs are broadcast.
COMMON = 500_000
#: Labels of bytes by the bits 1 (an A token ends) and 2 (a B token ends).
LABELS = np.frombuffer(b".ab|", np.uint8)
SPAN = re.compile(rb"[.ab]*\|")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int, b:int, n:int>>"


class ByteLevel:
    """Ids by a byte-level BPE file. Texts of Latin letters take a quicker engine over the same vocabulary, whose ranks
    are the ids; that its merges are in the order of their ids is checked, and otherwise the file's own engine runs."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.spelling = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        ranks = {}
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.spelling[i] = bytes(byte_of[c] for c in token)
                if i < 256 + len(merges):
                    ranks[self.spelling[i]] = i
        ordered = all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges))
        import public_tokenizers

        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if not self.quick:
            return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self.quick(t) if max(t) < "ɐ" else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """Ids by a piece model that puts a space in front. ``separators`` are the characters before which, after another
    character, no piece reaches."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        self.spelling, normal = [b""] * len(ids), []
        for i in ids:
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i)):
                self.spelling[i] = piece.replace("▁", " ").encode()
                normal.append(piece)
        self.front = m.piece_to_id("▁")
        self.separators = "".join(c for c in "\n\t" if not any(c in p for p in normal))
        if self.spelling[self.front] == b" " and not any(re.search("[^▁]▁", p) for p in normal):
            self.separators += " "

    def __call__(self, units: list[str]) -> list[list[int]]:
        """Of units that begin with a space, which the model adds itself, or with another separator, which it never
        joins with that space."""
        out = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.front] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, out, strict=True)]


class Aligner:
    """Groups and links of texts by two tokenizers."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        self.a, self.b, self.remembered = ByteLevel(path_a), Pieces(path_b), remembered
        self.bytes_a, self.bytes_b = (np.array([len(s) for s in t.spelling], np.int64) for t in (self.a, self.b))
        self.wide = len(self.b.spelling)
        self.text_a, self.text_b = ([str(i) for i in range(len(t.spelling))] for t in (self.a, self.b))
        c = re.escape(self.b.separators)
        self.units = re.compile(rf"\s*\S+(?:[^\S{c}]\s*\S*)*|\s+") if c else None
        self.known: dict[str, tuple | None] = {}

    def _labels(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        labels = np.zeros(size, np.uint8)
        labels[np.cumsum(self.bytes_a[a]) - 1] |= 1
        labels[np.cumsum(self.bytes_b[b]) - 1] |= 2
        return labels

    def _learn(self, units: list[str]) -> list[tuple | None]:
        """``(n_a, n_b, n_groups, groups, links)`` of each unit, links as codes; null if a tokenizer doesn't spell it."""
        spelled, out = [], []
        for unit, a, b in zip(units, self.a(units), self.b(units), strict=True):
            data = unit.encode()
            same = data == b"".join([self.a.spelling[i] for i in a]) == b"".join([self.b.spelling[i] for i in b])
            spelled.append((len(data), a, b) if same else None)
        fine = [s for s in spelled if s]
        if not fine:
            return [None] * len(units)
        a, b = (np.array([i for s in fine for i in s[k]], np.int64) for k in (1, 2))
        labels = self._labels(a, b, sum(s[0] for s in fine))
        line = LABELS[labels].tobytes()
        ends = np.flatnonzero(labels)
        before_a, before_b = (np.cumsum(labels & bit > 0)[ends] - (labels[ends] & bit > 0) for bit in (1, 2))
        codes = a[before_a] * self.wide + b[before_b]
        at = link = 0
        for s in spelled:
            if not s:
                out.append(None)
                continue
            size, ids_a, ids_b = s
            groups, i, j = [], 0, 0
            for span in SPAN.findall(line, at, at + size):
                n_a, n_b = span.count(b"a") + 1, span.count(b"b") + 1
                groups.append(",".join([self.text_a[x] for x in ids_a[i : i + n_a]]) + "|" + ",".join([self.text_b[x] for x in ids_b[j : j + n_b]]))
                i, j = i + n_a, j + n_b
            at += size
            n_links = len(ids_a) + len(ids_b) - len(groups)
            out.append((len(ids_a), len(ids_b), len(groups), ";".join(groups), codes[link : link + n_links].tobytes()))
            link += n_links
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple | None]:
        """The same of whole texts, each with a space in front; null for texts without tokens."""
        known, long = self.known, {}
        found = [[] if not t or "▁" in t else self.units.findall(" " + t) if self.units else [" " + t] for t in texts]
        new = list({u: None for units in found for u in units if u not in known})
        for unit, entry in zip(new, self._learn(new) if new else [], strict=True):
            (known if len(unit) <= LONGEST else long)[unit] = entry
        out = []
        for text, units in zip(texts, found, strict=True):
            entries = [known[u] if u in known else long[u] for u in units]
            if not entries:
                out.append(None)
            elif None in entries:
                out.append(self._learn([" " + text])[0] if len(units) > 1 else None)
            else:
                n_a, n_b, n_groups, groups, links = zip(*entries, strict=True)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        if len(known) > self.remembered:
            known.clear()
        return out


#: A worker keeps what it has learnt for the tasks that follow.
LEARNT: dict[tuple[str, str], Aligner] = {}


def _blocks(texts: list[str | None]):
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id n_a n_b n_groups n_links groups links``; ``groups`` are the ids of A and B of each
    group (``a1,a2|b1;a3|b2,b3``), ``links`` the linked id pairs with their number."""

    def run(batches):
        if (path_a, path_b) not in LEARNT:
            LEARNT[path_a, path_b] = Aligner(path_a, path_b)
        aligner = LEARNT[path_a, path_b]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, block in _blocks(texts):
                numbers, groups, codes, times, sizes = [], [], [], [], [0]
                for entry in aligner(block):
                    n_a, n_b, n_groups, text, links = entry or (0, 0, 0, "", b"")
                    code, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                    numbers.append((n_a, n_b, n_groups, len(links) // 8))
                    groups.append(text)
                    codes.append(code)
                    times.append(n)
                    sizes.append(len(code))
                code, n = np.concatenate(codes), np.concatenate(times)
                links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (code // aligner.wide, code % aligner.wide, n)], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + len(block)], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), links)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """``a b count best`` of all id pairs, from rows ``a b n``; ``best``: no pair of that B id has a higher count. A B id
    has at most as many pairs as A has ids."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def common_count(pairs: DataFrame, most: int = COMMON) -> int:
    """The smallest power of two (or 1) that at most ``most`` of the pairs' counts reach, from at most 64 rows."""
    sizes = {r["k"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    total = 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            return 2 ** (k + 1)
    return 1


def link_strength(aligned: DataFrame, most: int = COMMON) -> DataFrame:
    """``row n_best count_sum`` per row of ``aligned`` (with a unique ``row``) that has links: how many of its links hold
    a best pair of their B id, and the sum of the counts of all its links' pairs."""
    links = aligned.select("row", F.inline("links"))
    pairs = written(pair_counts(links), "pairs")
    least = common_count(pairs, most)
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    common = F.broadcast(pairs.filter(F.col("count") >= least))
    if least == 1:
        return links.join(common, ["a", "b"]).groupBy("row").agg(*sums)
    met = links.join(common, ["a", "b"]).groupBy("row").agg(*sums)
    rare = links.join(common, ["a", "b"], "left_anti").join(pairs.filter(F.col("count") < least), ["a", "b"]).groupBy("row").agg(*sums)
    return met.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, most: int = COMMON) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"), *vocabularies())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = written(out.withColumns({"groups_sha256": digest, "row": F.monotonically_increasing_id()}).drop("groups"), "aligned")
    rows = aligned.drop("links").join(link_strength(aligned, most), "row", "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLES: dict[str, str] = {}
