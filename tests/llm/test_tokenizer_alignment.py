"""Alignment of tokenizers against whole-text encoding and sets of offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from fixtures import prose
from pyspark.sql import functions as F

from tideline.llm import tokenizer_alignment as ta


def token_bytes():
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = ta.vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    printable = {**{c: c for c in range(33, 127)}, **{c: c for c in range(161, 173)}, **{c: c for c in range(174, 256)}}
    rest = [c for c in range(256) if c not in printable]
    byte_of = {chr(k): k for k in printable} | {chr(256 + i): c for i, c in enumerate(rest)}
    spell_a = {i: bytes(byte_of[c] for c in t) for t, i in json.load(open(path_a))["model"]["vocab"].items() if t != "<|endoftext|>"}
    spell_b = {i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(3, b.get_piece_size())}
    return a, b, spell_a, spell_b


def ends(ids, spelling):
    at, out = 0, []
    for i in ids:
        at += len(spelling[i])
        out.append(at)
    return out


def plain_version(rows):
    """Per row, from the definitions: byte ranges compared one with another."""
    a, b, spell_a, spell_b = token_bytes()
    seen, counts = [], Counter()
    for key, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        data = (" " + (text or "")).encode()
        if not text or data != b"".join(spell_a[i] for i in ids_a) or data != b"".join(spell_b[i] for i in ids_b):
            seen.append((key, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = ends(ids_a, spell_a), ends(ids_b, spell_b)
        links, first = [], 0
        for i, (end, x) in enumerate(zip(ends_a, ids_a, strict=True)):
            start = ends_a[i - 1] if i else 0
            while ends_b[first] <= start:
                first += 1
            j = first
            while j < len(ids_b) and (ends_b[j - 1] if j else 0) < end:
                links.append((x, ids_b[j]))
                j += 1
        cuts, groups, p, q = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for cut in cuts:
            i, j = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            groups.append(",".join(map(str, ids_a[p:i])) + "|" + ",".join(map(str, ids_b[q:j])))
            p, q = i, j
        counts.update(links)
        seen.append((key, len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(key, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for key, na, nb, ng, links, g in seen]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    texts = [None, "", " ", "  ", "word", " lead", "trail ", "trail  ", "trail \n", "\nx", "\n\n  a\tb \t\n c", "a\r\nb\r\n\r\n c", "{\r\n}\r x", "x y   z　　w", "a  b\x1c \x85c", "bad ▁ one", "▁", "<|endoftext|> and <s> </s> <unk> <0x0A>", "\x00 \x01a", "🙂👍🏽 ok", "日本語 テキスト です", "don't we'll I'M x's", "12345 1,234.50 ½ ²x", "ﬁ é é ſtraße", "a" * 300, "ü" * 200, "-" * 500 + "  " * 40 + "=" * 30, "مرحبا بالعالم", "tab\t\tindent\n    code()\n\treturn"]
    texts += [prose(rng, rng.choice([1, 3, 30, 400])) for _ in range(60)]
    alphabet = ["a", "B", " ", " ", "\n", "\t", "\r", " ", "1", ".", "é", "漢", "▁", "'s", "\x0b", " "]
    texts += ["".join(rng.choices(alphabet, weights=[9, 3, 9, 3, 3, 2, 1, 1, 3, 3, 2, 1, 0.2, 2, 0.5, 0.5], k=rng.randrange(1, 60))) for _ in range(400)]
    return [(None if i % 50 == 49 else i // 2, t) for i, t in enumerate(texts + texts[5:40])]


@pytest.mark.parametrize("most", [ta.COMMON, 20])
def test_equals_a_plain_version(spark, odd, tmp_path, most):
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ta.op11_tokenizer_alignment(spark, str(tmp_path), most).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_version(odd)))
    assert sum(r["n_links"] for r in got) > 10_000


def test_few_units_are_remembered(odd):
    texts = [t for _, t in odd]
    paths = ta.vocabularies()
    one, many = ta.Aligner(*paths, remembered=10), ta.Aligner(*paths)
    assert [x for t in texts for x in one([t])] == many(texts)
    assert len(one.known) <= 10 + max(len((t or "").split()) for t in texts)


def test_a_whole_text_without_units(odd):
    texts = [t for _, t in odd]
    whole = ta.Aligner(*ta.vocabularies())
    whole.units = None
    assert whole(texts) == ta.Aligner(*ta.vocabularies())(texts)


def test_extra_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 3)], "doc_id long, text string, groups string, n_a int")
    row = ta.align(docs, *ta.vocabularies()).first()
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (2, 2, 2, 2) and len(row["links"]) == 2
    assert ta.align(docs.limit(0), *ta.vocabularies()).count() == 0


def test_counts_of_common_pairs(spark):
    pairs = spark.range(1, 101).select((2 ** (F.col("id") % 7)).cast("long").alias("count"))
    for most in (0, 1, 14, 15, 40, 99, 100, 500):
        least = ta.common_count(pairs, most)
        assert pairs.filter(F.col("count") >= least).count() <= most
        assert least == 1 or pairs.filter(F.col("count") >= least // 2).count() > most
