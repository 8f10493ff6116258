"""Corpus operators against plain versions that follow their definitions word for word."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tideline.llm import deep_shallow, packing, pii, quality_classifier, quality_rules, registry, secret_scan, simhash, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df) -> dict:
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def documents(spark, sf_dir) -> dict:
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("where", ["small", "sf"])
def test_query_equals_its_sql(spark, small, name, where):
    sf_dir = SF if where == "sf" else small[0]
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def removed_bytes(docs: dict, width: int) -> dict:
    seen, out = set(), {}
    for doc_id in sorted(docs):
        raw = (docs[doc_id] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(raw[i : i + width])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


@pytest.mark.parametrize("where", ["small", "sf"])
def test_op1_against_all_strings(spark, small, where):
    sf_dir = SF if where == "sf" else small[0]
    got = by_id(suffix_dedup.op1_suffix_array_dedup(spark, sf_dir))
    want = removed_bytes(documents(spark, sf_dir), 100)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("tasks", [1, 7])
def test_op1_repeated_rows_are_one_document(spark, tasks):
    """Equal rows of 200 bytes and more keep what stands nowhere before their document, in one task and in several."""
    rng = random.Random(8)
    part = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(5)]
    docs = {1: part[0], 2: part[1] + part[0], 3: part[1][:220], 4: part[2] + "-" + part[2], 5: part[3], 6: part[3], 7: part[4][:250]}
    want = removed_bytes(docs, 100)
    assert [want[k][1] for k in (1, 2, 3, 4, 5, 6, 7)] == [0, 300, 220, 300, 0, 300, 0]
    rows = [r for r in docs.items() for _ in range(3)]
    got = suffix_dedup.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) == want[r["doc_id"]]


def test_suffixes_are_sorted_by_deep_shallow():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 99, 3000), np.full(700, 97), rng.integers(97, 99, 500)]).astype(np.uint8)
    text = np.concatenate([text, text[100:1500]])
    at = np.arange(len(text) - 100)
    order, *_ = deep_shallow.sort_suffixes(text, at, 100)
    strings = [text[i : i + 100].tobytes() for i in order]
    assert strings == sorted(strings)


@pytest.mark.parametrize("where", ["small", "sf"])
def test_op9_against_all_windows(spark, small, where):
    sf_dir = SF if where == "sf" else small[0]
    words = {k: WORD.findall(t or "") for k, t in documents(spark, sf_dir).items()}
    many = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - 34) if many[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    got = by_id(substring_dedup.op9_substring_dedup(spark, sf_dir))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == want


def test_op9_full_sketch_loses_nothing(spark, small):
    """With a sketch of 1024 counters nearly all windows pass the prefilter, and the result is the same."""
    base = substring_dedup.R.identified(spark.read.parquet(f"{small[0]}/documents.parquet"))

    def spans(log_width):
        got = substring_dedup.R.gathered(substring_dedup.repeated_windows(base, log_width=log_width), 8)
        return sorted((r["dk"], r["tk"], substring_dedup.R.read_spans(r["places"]).tolist()) for r in got.collect())

    assert spans(10) == spans(22)


def fingerprint(text: str | None) -> int:
    import xxhash

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps: dict, radius: int) -> dict:
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in fps}


@pytest.mark.parametrize("where", ["small", "sf"])
def test_op6_against_all_pairs(spark, small, where):
    sf_dir = SF if where == "sf" else small[0]
    fps = {k: fingerprint(t) for k, t in documents(spark, sf_dir).items()}
    least = components(fps, 4)
    got = by_id(simhash.op6_simhash_near_dedup(spark, sf_dir))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{fps[k]:016x}", least[k]) for k in fps}


def test_op6_links_of_crowded_cells(spark):
    """Dense fingerprints and a small limit of a cell, so that cells are dealt to several tasks."""
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {i: s for i, s in enumerate({rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(500)})}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps.values()], "fp long")
    links = simhash.links(nodes, 4, hot=20).collect()
    of = {signed(f): k for k, f in fps.items()}
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        x, y = sorted((find(of[r["a"]]), find(of[r["b"]])))
        root[y] = x
    assert {k: find(k) for k in fps} == components(fps, 4)


def best_fit(lengths: list[int], capacity: int) -> int:
    room: list[int] = []
    opened = 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        left = room.pop(at) if at < len(room) else capacity
        opened += left == capacity
        bisect.insort(room, left - n)
    return opened


@pytest.mark.parametrize("where", ["small", "sf"])
def test_op3_round_trip_and_best_fit(spark, small, where):
    import struct

    from tokenizers import Tokenizer

    sf_dir = SF if where == "sf" else small[0]
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = {}
    for k, text in documents(spark, sf_dir).items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[k, piece] = (start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = packing.op3_best_fit_packing(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 4096
    assert len(sequences) == best_fit([w[1] for w in want.values()], 4096)


def test_packing_plan_equals_best_fit_over_pieces():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 200))]
        runs = packing.plan_slots(Counter(lengths), capacity)
        assert len({s + i for _, _, n, s, _ in runs for i in range(n)}) == best_fit(lengths, capacity)
        assert sum(n for _, _, n, _, _ in runs) == len(lengths)


def test_word_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer, mine = Tokenizer.from_file(packing.vocabulary()), packing.WordIds(packing.vocabulary(), remembered=50)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("aZé ßÉİıǅ’'.,;!?-_/\\ \t\n\x0b  　日本語😀123٣ªº²Ⅷʰΐ￼") for _ in range(rng.randrange(1, 14)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert mine([text.encode()], b"")[0] == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)


def test_op5_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality_classifier.op5_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum((s >= 0.3) == q for s, q in held) / len(held) > 0.85


def test_op5_ignores_labels_of_held_out_rows(spark, small, tmp_path):
    """Scores don't change when the labels of the held-out fold are turned round."""
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    labels = spark.read.parquet(f"{small[0]}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = quality_classifier.held_out(F.col("doc_id"))
    labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    a, b = (by_id(quality_classifier.op5_quality_classifier(spark, str(p))) for p in (small[0], tmp_path))
    assert {k: r["score"] for k, r in a.items()} == pytest.approx({k: r["score"] for k, r in b.items()})


def test_op2_measures(spark, small):
    got = by_id(quality_rules.op2_quality_rules(spark, small[0]))
    for k, text in small[1].items():
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_spans(text: str, kinds: dict) -> list[str]:
    found = [(m.start(), i, m.end(), kind) for i, (kind, (regex, good)) in enumerate(kinds.items()) for m in re.finditer(regex, text) if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def pieces(rng: random.Random, parts: list[str]) -> str:
    return "".join(rng.choice(parts) for _ in range(rng.randrange(30)))


@pytest.mark.parametrize(
    ("query", "kinds", "parts"),
    [
        (pii.op10_pii, PERSONAL, ["1", "23", "256", "4111", "111111111111", ".", "..", " ", "-", "+", "(", ")", "@", "a", "b.c", "_%", "\n", "é", "😀", "x@y.zz", "", ""]),
        (secret_scan.op7_secret_scans, SECRETS, ["password", "TOKEN", "apikey", "Api_Key", "secret", "passwd", "'", '"', " ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "é", "😀", "\n", "K", "ſ", "."]),
    ],
)
def test_base_spans_of_patterns(spark, tmp_path, query, kinds, parts):
    from fixtures import tables

    rng = random.Random(11)
    docs = [pieces(rng, parts) for _ in range(1500)] + ["1" * 3000, "a" * 3000 + "@", "1 " * 700 + "4111111111111111", "a.b@" * 50 + "c.d", "password=" * 40]
    got = by_id(query(spark, tables(tmp_path, docs)))
    for k, text in enumerate(docs, 3):
        want = base_spans(text, kinds)
        assert got[k]["base_sha256"] == sha(",".join(want)), repr(text)
        assert set(want) <= set(got[k]["spans"].split(",") if got[k]["spans"] else [])
        for kind in kinds:
            assert got[k][f"n_{kind}"] == sum(s.startswith(kind) for s in want)


def test_disclosing_terms_against_all_pairs(spark):
    """Every pair of an entity and a term is rated from its definition; copies, repeated rows and shared sets included."""
    rng = random.Random(23)
    names, people, plain = [f"u{i}@m.org" for i in range(30)], [f"Person{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(31)], ["common", "words", "stand", "here", "often"]
    rows = []
    for i in range(260):
        who = rng.sample(range(30), rng.choice([0, 0, 0, 0, 1, 1, 2]))
        about = [people[w] for w in who if rng.random() < 0.8] + [people[w + 1] for w in who if rng.random() < 0.5]
        rows.append((i, " ".join(rng.sample(plain, 3) + about + [names[w] for w in who] + ([f"alone{chr(97 + i % 26) * (i % 7 + 1)}"] if who and rng.random() < 0.2 else []))))
    rows += rows[:4] * 2 + [(900 + i, t) for i, (_, t) in enumerate(rows[:20])]
    terms = {k: {w.lower() for w in re.findall(r"[^\W\d_]+", t) if len(w) >= 4} for k, (_, t) in enumerate(rows)}
    held = {k: set(re.findall(r"u\d+@m\.org", t)) for k, (_, t) in enumerate(rows)}
    bad = set()
    for entity in names:
        with_it = {k for k in held if entity in held[k]}
        share = len(with_it) / len(rows)
        for term in set().union(*terms.values()):
            having = {k for k in terms if term in terms[k]}
            rate = (len(having & with_it) + pii.SMOOTH * share) / (len(having) + pii.SMOOTH)
            if share and rate * 100 >= pii.DISCLOSURE and rate >= share * 2**pii.BITS:
                bad.add(term)
    assert len(bad) > 5 and len(set().union(*terms.values()) - bad) > 5
    want = {}
    for i, text in rows:
        spans = [(m.start(), m.end(), "email") for m in re.finditer(r"u\d+@m\.org", text)]
        spans += [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in bad and not any(a < m.end() and b > m.start() for a, b, _ in spans)]
        if spans:
            want[i] = sorted(spans)
    got = {r["dk"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
