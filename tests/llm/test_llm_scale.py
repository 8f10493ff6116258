"""Cases that only size brings out: many matches in a text, hot anchors, grids, ledgers, bitmaps."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from fixtures import prose
from pyspark.sql import functions as F

from tideline.llm import chat_format, decontaminate, pii, quality_classifier, secret_scan, simhash, spans, substring_dedup, suffix_dedup


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_running_values(spark):
    values = [random.Random(1).randrange(50) for _ in range(9000)]
    df = spark.createDataFrame([(values,), ([],), ([7],)], "v array<int>")
    sums = [r[0] for r in df.select(spans.running(F.col("v"), lambda a, b: a + b)).collect()]
    tops = [r[0] for r in df.select(spans.running(F.col("v"), lambda a, b: F.greatest(a, b))).collect()]
    assert sums == [[0, *np.cumsum(values)[:-1].tolist()], [], [0]]
    assert tops == [[0, *np.maximum.accumulate(values)[:-1].tolist()], [], [0]]


def test_parts_of_a_text_by_chunks(spark):
    text = "".join(random.Random(2).choice("aé😀\n ") for _ in range(1500))
    cuts = [(0, 0), (0, 1), (250, 260), (255, 256), (256, 512), (300, 1500), (1499, 1500), (1490, 1600)]
    got = one(spark, text).select(*(spans.taken(spans.chunks(F.col("text")), F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(cuts))).first()
    assert list(got) == [text[a:b] for a, b in cuts]


@pytest.mark.parametrize("kind", ["email", "secret"])
def test_many_matches_in_a_text(spark, kind):
    """Sixteen times the matches take about sixteen times as long, and all are found and replaced."""
    word, run, mark, few = {
        "email": ("a.b{}@c.de", lambda d: pii.sanitise(d), "[email]", 500),
        "secret": ("token=abcdef{:08d}", lambda d: secret_scan.stage(spark, d, ""), "[secret]", 2000),
    }[kind]
    took = {}
    for n in (50, few, 16 * few):  # the first run warms up
        began = time.perf_counter()
        text = run(one(spark, " ".join(word.format(i % 97) for i in range(n)))).first()["text"]
        took[n] = time.perf_counter() - began
        assert text == " ".join([mark] * n)
    assert took[16 * few] < 16 * took[few] + 10


def test_counts_of_repeated_rows(spark):
    """A repeated row counts as often as it stands, so a support of five can come from copies of a row."""
    rows = [(1, "ask Zebulon at x@y.org")] * 5 + [(i, "ask at will") for i in range(2, 200)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [[s["kind"] for s in r["spans"]] for r in got] == [["term", "email"]]


def test_a_term_inside_an_entity_is_no_span(spark):
    rows = [(i, f"please write today {i}") for i in range(200)]
    rows += [(300, "Zebulon zebulon@y.org please"), (301, "zebulon@y.org zebulon"), (302, "Zebulon please")]
    got = {r["dk"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {300: [("term", 0, 7), ("email", 8, 21)], 301: [("email", 0, 13), ("term", 14, 21)], 302: [("term", 0, 7)]}


def test_hot_anchors_are_summed_over_batches(spark):
    """An anchor with one occurrence in each batch is hot; at most a few per bucket are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        base = spark.createDataFrame([("x",)] * 400, "text string").repartition(7)
        count = iter(range(10**9))
        anchors = lambda texts: np.array([11, *[10**6 + random.randrange(10**9) for _ in texts]], np.uint64)
        assert next(count) == 0 and suffix_dedup.R.hot_anchors(base, anchors, 4, 1.0, 100).tolist() == [11]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op1_with_a_hot_anchor_in_different_surroundings(spark, monkeypatch):
    """Strings of a hot anchor are dealt one by one, and the result is that of all strings."""
    from test_llm_brute_force import removed_bytes, sha

    rng = random.Random(3)
    line = "".join(rng.choice("abcdefg ") for _ in range(110))
    docs = {i: prose(rng, 30) + (line if i % 3 else "") + prose(rng, 30) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(suffix_dedup.R, "hot_anchors", lambda base, anchors_of, n: np.unique(anchors_of([line])))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in suffix_dedup.suffix_array_dedup(df).collect()}
    assert got == removed_bytes(docs, 100) and any(w[1] for w in got.values())


def test_equal_hashes_of_unequal_bytes_are_told_apart():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    at, size, order = np.array([0, 3, 6]), np.array([3, 3, 3]), np.array([0, 2, 1])
    assert suffix_dedup.same_text(np.array([False, True, True]), order, data, at, size).tolist() == [False, True, False]


def test_numbers_as_gaps():
    rng = np.random.default_rng(3)
    for top in (1, 127, 128, 129, 16383, 2**21, 2**40, 2**62):
        for n in (0, 1, 2, 1000):
            cells = np.unique(rng.integers(0, top, n, np.int64, endpoint=True))
            assert substring_dedup.unpacked(substring_dedup.packed(cells)).tolist() == cells.tolist()


@pytest.mark.parametrize("factor", [1, 10])
def test_merged_sketches_of_partitions(factor):
    """However many anchors there are: about one in twenty unique ones passes wrongly, no repeated one is lost, and what a
    partition sends is about two bytes an anchor for eight partitions and four for two hundred."""
    rng = np.random.default_rng(factor)
    n, n_slices = 40_000 * factor, 4
    keys = np.unique(rng.integers(0, 2**63, n + 1000, np.uint64))
    rng.shuffle(keys)
    unique, again = keys[:n], keys[n : n + 500]
    for n_parts, most in ((8, 2.5), (200, 4.5)):
        log_width = int(substring_dedup.ROOM * len(unique) / n_slices).bit_length()
        merged = [substring_dedup.Sketch(log_width) for _ in range(n_slices)]
        parts = [np.concatenate([p, again[i::n_parts], again[(i + i // 2) % n_parts :: n_parts]]) for i, p in enumerate(np.array_split(unique, n_parts))]
        sent = 0
        for part in parts:
            for s, cells, twice in substring_dedup.sketches(part, log_width, n_slices):
                data = substring_dedup.packed(cells)
                merged[s].merge(substring_dedup.unpacked(data), twice)
                sent += len(data) + len(twice) // 8
        every, counts = np.unique(np.concatenate(parts), return_counts=True)
        of = substring_dedup.R.bucket_of(every, n_slices)
        passed = np.zeros(len(every), bool)
        for s, sketch in enumerate(merged):
            passed[of == s] = np.logical_and.reduce([sketch.repeated(c) for c in substring_dedup.cells_of(every[of == s], log_width)])
        assert passed[counts > 1].all() and (counts > 1).any()
        assert passed[counts == 1].mean() < 0.06
        assert sent / counts.sum() < most


@pytest.mark.parametrize("groups", [5, 6, 7, 8, 10])
def test_every_grid_gives_the_same_links(spark, groups):
    from test_llm_brute_force import components

    rng = random.Random(groups)
    seeds = [rng.getrandbits(64) for _ in range(10)]
    fps = dict(enumerate(sorted({rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(200)})))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = {signed(f): k for k, f in fps.items()}
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps.values()], "fp long"), groups=groups).collect():
        x, y = sorted((find(of[r["a"]]), find(of[r["b"]])))
        root[y] = x
    assert {k: find(k) for k in fps} == components(fps, 4)


def test_candidates_stay_few():
    """The grid narrows its cells as fingerprints grow: work per fingerprint grows far slower than their number."""
    cost = lambda n: (lambda rows, pairs: 100 * rows + pairs)(*simhash.expected(n, simhash.grid(n)))
    assert cost(10**7) < 3 * cost(10**5) and cost(5 * 10**10) < 60 * cost(10**5)


def test_copies_beyond_a_number_get_their_component_too(spark):
    rows = [(i, "") for i in range(30)] + [(i, f"some words of text {i // 3}") for i in range(30, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, copies=c).collect()} for c in (2, 10**9))
    assert a == b and len(a) == 60 and a[29] == 0


def test_ledger_at_a_path(spark, tmp_path):
    """A second run scans nothing that the ledger has; fresh texts and rule versions are added; results are the same."""
    from dataclasses import replace

    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefabcdef99"), (2, "nothing"), (3, "token=abcdefabcdef99")], "doc_id long, text string")
    spans_of = lambda found: sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secret_scan.with_spans(docs, found).collect())
    found, rows = secret_scan.scan(docs, path)
    first, n = spans_of(found), rows.count()
    assert n == 2 * len(secret_scan.RULES)
    found, rows = secret_scan.scan(docs, path)
    assert rows.count() == 0 and spans_of(found) == first and secret_scan.read_ledger(spark, path).count() == n
    rules = (replace(secret_scan.RULES[0], version=2), *secret_scan.RULES[1:])
    found, rows = secret_scan.scan(docs.union(one(spark, "fresh")), path, rules)
    assert rows.count() == 2 + len(rules) and spans_of(found) == first


def test_two_scans_at_a_time_and_blobs_of_other_tables(spark, tmp_path):
    """Rows that two scans both wrote count once; rows of texts that this table lacks don't come back."""
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefabcdef99"), (2, "nothing")], "doc_id long, text string")
    found, rows = secret_scan.scan(docs, path)
    before = sorted(map(str, found.collect()))
    rows.write.mode("append").parquet(path)  # the other scan
    found, _ = secret_scan.scan(docs, path)
    assert sorted(map(str, found.collect())) == before and before
    other, _ = secret_scan.scan(docs.filter("doc_id = 2"), path)
    assert other.count() == 0


def test_stock_phrase_in_many_items(spark):
    """A phrase that all items and documents share makes hits, but contaminates nothing by itself."""
    rng = random.Random(8)
    phrase = "once upon a time there was a small grey"
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, f"{phrase} {own(30)}") for i in range(60)]
    docs = [(i, f"{own(20)} {phrase} {own(20)}") for i in range(40)] + [(100, f"{own(5)} {items[7][1]}"), (101, own(30)), (101, own(30)), (None, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"]} == {100: "7"} and len(got) == len(docs)


def test_only_texts_with_hits_meet_their_hits(spark):
    """Whatever their number, documents pass a bitmap before their texts are sent: all with a hit do, and few others."""
    docs = decontaminate.keyed(spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    hit = docs.filter("dk % 10 = 0").select("dk", "tk")
    met = decontaminate.possible(docs, hit, "xxhash64(dk, tk)")
    assert met.columns == docs.columns and met.join(hit, ["dk", "tk"], "left_semi").count() == 2000
    assert met.count() < 2100


def test_seeds_by_bitmap_equal_seeds_by_broadcast(spark, small):
    docs, items = (spark.read.parquet(f"{small[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, decontaminate.contamination(docs, items, broadcast_seeds=n).collect())) for n in (0, 10**6))
    assert a == b and a


def test_parts_of_items(spark):
    """Words put in or left out, a long stretch, and items of one and two words."""
    rng = random.Random(5)
    item = [f"w{i}" for i in rng.sample(range(1000), 60)]
    docs = {
        1: item[:30] + ["more"] + item[30:],
        2: item[:46],
        3: item[:18],
        4: ["lead", *item[5:20], "x", *item[21:30]],
        5: ["alpha"],
        6: ["say", "alpha", "now"],
        7: ["alpha", "beta"],
        8: ["say", "gamma", "delta", "epsilon", "now"],
        9: [*item[:29], *item[31:]],
    }
    items = [(1, " ".join(item)), (2, "alpha"), (3, "alpha beta"), (4, "gamma delta epsilon")]
    got = decontaminate.decontaminate(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == {1: "1", 2: "1", 3: "", 4: "1", 5: "2", 6: "", 7: "3", 8: "4", 9: "1"}


def test_empty_benchmark_leaves_documents_clean(spark):
    got = decontaminate.decontaminate(one(spark, "any words at all " * 20), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["contaminated"], r["item_ids"]) for r in got] == [(False, "")]


@pytest.mark.parametrize("kind", ["im_end", "im_start", "im_end|>\n", "<|x", "", "a b"])
def test_no_type_of_a_part_is_a_mark(spark, kind):
    df = spark.createDataFrame([(1, 0, "user", [(kind, None, "ref", None)])], f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    row = chat_format.format_chat(df).first()
    assert row["formatted"] == "<|im_start|>user\n<|part|><|im_end|>\n" and row["attachments"][0]["type"] == kind


def test_op5_scores_equal_a_plain_discriminant(spark):
    """Scores of a small table against the densities of the shrunk Gaussians, worked out from the definition."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(5, 80)) + (" ### !!! 123" * rng.randrange(4)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = quality_classifier.document_statistics(docs)
    y = np.array([rng.randrange(2) for _ in texts])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if i < 60], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(stats, quality_classifier.fit(stats, labels)).collect()}
    x = np.array([quality_classifier.statistics(t) for t in texts])
    train, known = x[:60], y[:60]
    cov = [np.cov(train[known == k].T, bias=True) for k in (0, 1)]
    share = [(known == k).mean() for k in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    logs = []
    for k in (0, 1):
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        d = (x - train[known == k].mean(axis=0)) / scale
        logs.append(np.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert [got[i] for i in range(80)] == pytest.approx(want.tolist(), abs=1e-6)


def test_many_addresses_in_one_text(spark, tmp_path):
    """The query's time grows with the matches of a text, not with their square: start-up is taken off first."""
    took = {}
    for n in (50, 51, 10_000, 80_000):  # the first run warms up
        one(spark, " ".join(f"user{i}@host{i}.org noun{chr(97 + i % 26) * 4}" for i in range(n))).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        began = time.perf_counter()
        assert pii.op10_pii(spark, f"{tmp_path}/{n}").first()["n_email"] == n
        took[n] = time.perf_counter() - began
    assert took[80_000] - took[51] < 9 * max(took[10_000] - took[51], 2)
