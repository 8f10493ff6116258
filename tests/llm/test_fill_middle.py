"""Fill-in-middle against a plain version, and its bit vectors against counting."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from fixtures import prose

from tideline.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or h3 % 100 >= 50 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (len(tokens), "plain", None, None, text)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 80 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (len(tokens), "spm" if h4 % 100 < 80 else "psm", len(prefix), len(middle), out)


@pytest.fixture(scope="module")
def odd():
    import random

    rng = random.Random(9)
    texts = [None, "", " ", "\t\n x", "word", "a <P> b", "a <S b <M c", "<<", "ü　é \x0b\x0c z", "x\x00y z", "  lead", "trail  ", "a b c", "🙂 🙂🙂\n"]
    texts += [prose(rng, rng.choice([1, 2, 7, 63, 64, 65, 600])) for _ in range(150)] + ["w " * 30_000]
    return [(None if i % 41 == 40 else i // 2, t) for i, t in enumerate(texts * 3)]


def test_equals_a_plain_version_and_restores(spark, odd):
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_middle.restored(out["output"], out["form"])).collect()
    want = [(k, *plain_version(k, t), t or "") for k, t in odd]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_extra_columns_and_no_rows(spark, odd):
    docs = spark.createDataFrame([(1, "a b", "mine", 3)], "doc_id long, text string, output string, n int")
    assert [r["n"] for r in fill_middle.fill_in_middle(docs).collect()] == [2]
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "share"), [(1, 1.0), (64, 0.5), (511, 0.0), (512, 1.0), (513, 0.9), (40_000, 0.001), (40_000, 0.6)])
def test_rank_and_select(size, share):
    bits = np.random.default_rng(size).random(size) < share
    vector, at = fill_middle.BitVector(bits), np.arange(size + 1)
    assert vector.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    places = np.flatnonzero(bits)
    assert vector.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()
