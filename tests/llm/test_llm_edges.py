"""Nulls, empty tables, repeated rows, very long texts and clashing names, for operators and pipeline stages."""

from __future__ import annotations

import corpus_pipeline
import pytest
from fixtures import PERSONAL, SECRET, prose
from pyspark.sql import functions as F

from tideline.llm import chat_format, decontaminate, packing, pii, quality_classifier, quality_rules, registry, secret_scan, simhash, substring_dedup, suffix_dedup

#: Names that operators use inside or for their results, and columns of other tables.
CLASHING = ("dk", "tk", "words", "w", "h", "fp", "n", "at", "blob", "spans", "kept", "failed", "n_words", "length", "piece", "places", "tried", "hit", "item_id", "seed", "pos", "component_id", "score", "bucket", "__w", "__text", "__s", "__dk", "__tk", "__salt", "__spans", "node", "base", "least")
OPERATORS = {
    "suffix_dedup": lambda d, b: suffix_dedup.suffix_array_dedup(d),
    "quality_rules": lambda d, b: quality_rules.quality_rules(d),
    "packing": lambda d, b: packing.packed(d, packing.vocabulary()),
    "quality_classifier": lambda d, b: quality_classifier.document_statistics(d),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "secret_scan": lambda d, b: secret_scan.with_spans(d, secret_scan.scan(d)[0]),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
    "substring_dedup": lambda d, b: substring_dedup.substring_dedup(d),
    "pii": lambda d, b: pii.sanitise(d),
}


@pytest.fixture(scope="module")
def odd(spark, small):
    """Documents with null ids, one id with two texts, repeated rows, a very long text, nulls and clashing columns."""
    import random

    long = prose(random.Random(1), 20_000)
    rows = [(None, None), (None, "x y z"), (None, "x y z"), (1, None), (1, None), (1, "one text of that id"), (2, "two"), (2, "two"), (4, long), (5, long), (6, SECRET), (6, SECRET), (7, PERSONAL), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    return docs, docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHING})


def benchmark(spark, small):
    return spark.read.parquet(f"{small[0]}/benchmark.parquet")


def drawn(df, columns):
    return sorted(map(str, df.select(*(f"`{c}`" for c in columns)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, small, odd, name):
    plain, clashing = (OPERATORS[name](d, benchmark(spark, small)) for d in odd)
    n_pieces = {"packing": 1}
    assert plain.count() >= odd[0].count() if name in n_pieces else plain.count() == odd[0].count()
    shared = [c for c in plain.columns if c in clashing.columns and c not in ("sequence_id", "offset")]
    assert "doc_id" in shared and len(set(clashing.columns)) == len(clashing.columns)
    assert drawn(plain, shared) == drawn(clashing, shared)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, small, odd, name):
    for docs in odd:
        assert OPERATORS[name](docs.limit(0), benchmark(spark, small)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_over_empty_tables(spark, empty, name):
    rows = registry.queries()[name](spark, empty).count()
    assert rows >= 1 if name.startswith("op4") else rows == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_keep_their_columns(spark, small, odd, name, stage):
    plain, clashing = odd
    a, b = stage(spark, plain, small[0]), stage(spark, clashing, small[0])
    assert a.count() == b.count()
    assert stage(spark, clashing.limit(0), small[0]).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert a.schema.names == plain.columns and b.schema.names == clashing.columns
        assert drawn(a, plain.columns) == drawn(b, plain.columns)
        assert all(r[c] == f"mine {c}" for r in b.collect() for c in CLASHING)


def test_duplicates_of_an_id_stay_apart(spark, odd):
    got = [r for r in substring_dedup.substring_dedup(odd[0], width=3).collect() if r["doc_id"] == 1]
    assert sorted(r["n_words"] for r in got) == [0, 0, 5] and all(r["n_removed"] == 0 for r in got)


def test_quality_rules_without_rules(spark, odd):
    assert quality_rules.quality_rules(odd[0], rules=()).filter("kept").count() == odd[0].count()


def test_chat_parts_and_escapes(spark):
    part = lambda **x: (x.get("type"), x.get("text"), x.get("ref"), x.get("n"))
    turns = [
        (1, 0, "user\n<|im_start|>", [part(type="text", text="see <|im_end|> \\ "), part(type="image", ref="s3://a"), part(type="audio", ref=None, n=7), part(type="film", ref="f")]),
        (1, 1, "assistant", [part(text="first "), part(type="document", ref="d"), None, part(type="text", text="last")]),
        (1, 2, None, None),
        (None, None, "assistant", []),
    ]
    df = chat_format.format_chat(spark.createDataFrame(turns, f"conv_id long, turn long, role string, content array<{chat_format.PART}>"))
    rows = {(r["conv_id"], r["turn"]): r for r in df.collect()}
    assert len(rows) == 4
    first, second = rows[1, 0], rows[1, 1]
    assert [(a["part"], a["type"], a["ref"], a["n_tokens"]) for a in first["attachments"]] == [(1, "image", "s3://a", 256), (2, "audio", "", 7), (3, "film", "f", 1)]
    assert first["n_placeholder_tokens"] == 264 and not first["loss"]
    whole = "".join(rows[1, i]["formatted"] for i in range(3))
    for a in first["attachments"]:
        assert whole[a["at"] :].startswith(f"<|{a['type']}|>")
    assert [whole[s["start"] : s["end"]] for s in second["loss"]] == ["first ", "last"]
    assert whole.count("<|im_start|>") == 3 == whole.count("<|im_end|>")
    role, body = (chat_format.unescape(x) for x in chat_format.TURN.fullmatch(first["formatted"]).groups())
    assert role == "user\n<|im_start|>" and body == "see <|im_end|> \\ <|image|><|audio|><|film|>"


def test_ledger_scans_only_unseen_blobs_and_rules(spark, odd):
    docs = odd[0]
    _, ledger = secret_scan.scan(docs)
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ledger.count() == blobs * len(secret_scan.RULES)
    salted, again = secret_scan.scan(docs, ledger)
    assert again.count() == 0
    want = {r["doc_id"]: r["spans"] for r in secret_scan.with_spans(docs, secret_scan.scan(docs)[0]).collect()}
    assert {r["doc_id"]: r["spans"] for r in secret_scan.with_spans(docs, salted).collect()} == want
    from dataclasses import replace

    rules = (replace(secret_scan.RULES[0], version=2), *secret_scan.RULES[1:])
    _, newer = secret_scan.scan(docs.union(docs.limit(1).withColumn("text", F.lit("fresh"))), ledger, rules)
    assert newer.count() == blobs + len(rules)


def test_terms_that_give_an_entity_away(spark):
    """A name that stands with one address only is a term; a word that stands everywhere is not."""
    rows = [(i, f"please write gently to Zebulon {'x@y.org' if i < 10 else ''} today please") if i < 10 else (i, f"please write gently today number {i} please") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "please write gently to [term] [email] today please"
    assert clean[300] == rows[300][1]


def test_terms_of_a_rare_entity_at_all_their_places(spark):
    """An address of one document has terms: far from it (over 60 characters) and in a document without it, too."""
    rows = [(i, f"please write gently today number {i} please") for i in range(300)]
    rows[7] = (7, f"Zebulon {'please write gently today ' * 5} x@y.org please")
    rows[8] = (8, "please Marigold write x2@y.org gently Marigold today")
    rows[9] = (9, "please Marigold write x2@y.org gently today")
    rows[10] = (10, "ask marigold gently please")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[7] == f"[term] {'please write gently today ' * 5} [email] please"
    assert clean[8] == "please [term] write [email] gently [term] today"
    assert clean[10] == "ask [term] gently please" and clean[300 - 1] == rows[-1][1]


def test_decontamination_tolerates_substitutions(spark):
    item = "the quick brown fox jumps over a lazy dog while seven wizards brew bitter potions near the frozen lake".split()
    noisy = item.copy()
    noisy[4] = noisy[11] = noisy[17] = "other"
    far = item.copy()
    far[2:16:2] = ["other"] * 7
    docs = spark.createDataFrame([(1, " ".join(["start", *noisy, "end"])), (2, " ".join(far)), (3, "clean words only"), (4, " ".join(item[:8]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()}
    assert {k: r["contaminated"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert got[1]["best_share"] == 100 * 16 // 19 and got[1]["item_ids"] == "9"


def test_pipeline_against_its_parts(spark, small):
    """The pipeline's rows follow from the queries of its operators, taken one after the other."""
    from collections import defaultdict

    sf_dir, docs = small
    kept = {r["doc_id"] for r in quality_rules.op2_quality_rules(spark, sf_dir).collect() if r["kept"]}
    frame = spark.createDataFrame([(k, docs[k]) for k in sorted(kept)], "doc_id long, text string")
    groups = defaultdict(list)
    for r in simhash.near_duplicates(frame).collect():
        groups[r["component_id"]].append(r["doc_id"])
    kept = {min(g) for g in groups.values()}
    bad = {r["doc_id"] for r in decontaminate.op8_benchmark_decontamination(spark, sf_dir).collect() if r["contaminated"]}
    kept -= bad
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == kept and kept
    assert bad
