"""Small functions over records, runs and models, with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import models, text as T
from tideline.operators import evaluation as E, frames as FR, graphs, integrity as I, keywords as K, timeline
from tideline.operators.training import Head
from tideline.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("missing", "score"), [("shown", 0.0), ("stored", None)])
def test_posts_without_a_sentiment(spark, missing, score):
    rows = [("u", 1, "2024-01-01T00:00:00+01:00", None, None), ("u", 2, "1970-01-01T00:00:01", "positive", 0.7), ("u", 3, "never", "negative", 0.1), ("u", 4, None, "negative", 0.1)]
    got = timeline.of_posts(spark.createDataFrame(rows, "user_id string, post_id long, timestamp string, label string, score double"), missing).collect()
    assert sorted((r["us"], r["label"], r["score"]) for r in got) == [(1_000_000, "positive", 0.7), (1_704_063_600_000_000, "neutral", score)]


def test_an_unknown_policy_is_an_error(spark):
    with pytest.raises(KeyError):
        timeline.of_posts(spark.createDataFrame([], "user_id string, post_id long, timestamp string, label string, score double"), "other")


@pytest.mark.parametrize(("user", "ok"), [("a.b-c@d_1", True), ("Ünal", True), ("", False), ("a b", False), ("x" * 64, True), ("x" * 65, False), ("a\n", True), ("a\nb", False), (None, False)])
def test_user_ids(spark, user, ok):
    assert one(spark, I.user_id_ok(F.lit(user).cast("string"))) is ok


@pytest.mark.parametrize(("post", "label", "problem"), [("p", "Hope", None), ("p", "None", None), ("p", "hope", "Invalid label"), ("", "Hope", "Missing data"), ("p", "", "Missing data"), (None, None, "Missing data")])
def test_corrections(spark, post, label, problem):
    assert one(spark, I.correction_problem(F.lit(post).cast("string"), F.lit(label).cast("string"))) == problem


def test_edges_of_a_node_and_of_a_relation(spark):
    edges = spark.createDataFrame([(0, 1, "adjacent"), (1, 2, "overlapping"), (2, 3, "adjacent")], "source_index int, target_index int, relation string")
    assert [(r["source_index"], r["target_index"]) for r in graphs.edges_touching(edges, F.lit(1)).collect()] == [(0, 1), (1, 2)]
    assert [r["target_index"] for r in graphs.edges_by_relation(edges, "adjacent").collect()] == [1, 3]


def test_outputs_of_models(spark):
    rows = [(1, 0, None, None, None, None, None, "", "s"), (1, 1, "1970-01-01T00:00:02", 0.5, 0.2, 0.3, 0.0, "i", "s"), (1, 2, None, 0.1, None, None, None, None, None)]
    got = FR.from_outputs(spark.createDataFrame(rows, "subject_id int, seq int, timestamp string, positive double, neutral double, negative double, uncertainty double, image_id string, source_id string"), 1_000_000).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, 1_000_000, 0, 0.0, 1.0, 0.0, 0.1, "s"), (1, 2_000_000, 1, 0.5, 0.2, 0.3, 0.0, "i"), (1, 1_200_000, 2, 0.1, 1.0, 0.0, 0.1, None)]


def test_top_results(spark):
    entries = lambda *e: F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).cast("double").alias("score")) for a, b in e))
    assert tuple(one(spark, T.top_result(entries(("a", 0.2), ("b", 0.7), ("c", 0.7), ("d", None))))) == ("b", 0.7)
    nested = F.array(entries(("x", 0.1), ("y", 0.3)), entries(("z", 0.9)))
    assert tuple(one(spark, T.top_result(T.first_list(nested)))) == ("y", 0.3)
    none = F.lit(None).cast("array<struct<label:string,score:double>>")
    assert tuple(one(spark, T.top_result(none))) == ("Uncategorized", 0.0) == tuple(one(spark, T.top_result(F.filter(entries(("a", 1)), lambda e: e["score"] > 2))))


def test_first_of_some_names():
    assert T.first_existing(["id", "text", "caption"], T.TEXT_NAMES) == "caption" and T.first_existing(["x"], T.LABEL_NAMES) is None


def test_concepts(spark):
    got = one(spark, K.main_concepts(F.array(F.lit("Big Red House"), F.lit("red house"), F.lit("housework"), F.lit("ME"), F.lit("ox")), F.lit(None).cast("array<string>"), F.array(F.lit("house"), F.lit("housework"))))
    assert got == ["big red house", "housework"]


def test_pixels_and_boxes(spark):
    assert one(spark, T.scale_pixels(F.array(F.lit(0), F.lit(255)))) == [-1.0, 1.0] and one(spark, T.scale_pixels(F.array(F.lit(51)), centred=False)) == [0.2]
    assert tuple(one(spark, T.box_with_offsets(F.lit(10), F.lit(20), F.lit(30), F.lit(40), 5, 6))) == (5, 45, 14, 66)


def test_grids_logs_and_runs(spark):
    assert E.parameter_grid(spark, lr=[1, 2], decay=["a", "b", "c"]).distinct().count() == 6
    with pytest.raises(ValueError, match="51"):
        E.parameter_grid(spark, a=list(range(51)))
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 0.6), (3, 0.4, 0.5), (4, None, None)], "step int, loss double, eval_loss double")
    train, held = E.learning_curves(log)
    assert [r["step"] for r in train.collect()] == [1] and [r["step"] for r in held.collect()] == [2, 3]
    runs = spark.createDataFrame([("2024-01",), ("2024-03",), ("2024-02",), ("sweep-9",)], "name string")
    assert {r["name"] for r in E.kept_runs(runs, 2).filter("keep").collect()} == {"2024-03", "2024-02"}
    spread = {r["metric"]: (r["mean"], r["std"]) for r in E.stability(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).collect()}
    assert spread == {"a": (2.0, pytest.approx(math.sqrt(2))), "b": (2.0, 0.0)}


def test_vectors_of_texts(spark):
    texts = ["Hello", None, "", " \n", "a", "Hello", "hello ", "日本語 text"]
    got = models.hashed_vectors(texts, 32)
    assert [v is None for v in got] == [False, True, True, True, False, False, False, False]
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in got if v is not None)
    assert (got[0] == got[5]).all() and (got[0] == got[6]).all() and not np.allclose(got[0], got[4])
    for text, vector in zip(texts, got, strict=True):
        alone = models.hashed_vectors([text], 32)[0]
        assert alone is None if vector is None else np.allclose(alone, vector)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(models.infer("embedding", F.col("t")).alias("v")).collect()
    assert sorted(r["v"] is None for r in rows) == [False] * 5 + [True] * 3 and len(rows[0]["v"]) == models.DIMENSIONS


def test_slots_of_models(spark):
    assert one(spark, models.text_scores(F.lit("happy day")))["positive"] == 0.5
    emotions = lambda text: F.array(*(F.struct(F.lit(a).alias("label"), (F.lit(b) + F.length(text) * 0).alias("score")) for a, b in (("joy", 0.25), ("surprise", 0.5), ("Anger", 0.125), ("other", 0.125))))
    before = models._REGISTRY["emotions"]
    try:
        models.register("emotions", emotions)
        assert tuple(one(spark, models.text_scores(F.lit("x")))) == (0.75, 0.125, 0.125)
    finally:
        models.register("emotions", before)
    with pytest.raises(KeyError, match="no model"):
        models.infer("other", F.lit(1))
    assert tuple(one(spark, models.infer("chime", F.lit("a friend in the community, hope")))) == ("Connectedness", 0.6667)
    assert tuple(one(spark, models.infer("sentiment", F.lit(" ")))) == ("neutral", 1.0)


def test_places_by_a_gazetteer(spark):
    rows = spark.createDataFrame([(1, 1.000001, 2.0), (2, 1.0, 2.0), (3, None, 2.0), (4, 5.0, 5.0)], "id int, lat double, lon double")
    known = spark.createDataFrame([(1.0, 2.000004, "shop", "bakery", "B"), (1.0, 2.0, "shop", "bakery", "A"), (None, 2.0, "x", "x", "x")], "lat double, lon double, category string, kind string, name string")
    got = {r["id"]: (r["location_text"], len(r["location_embedding"])) for r in models.enrich_locations(rows.filter("id <> 3"), known).collect()}
    assert got == {1: ("shop bakery A", 384), 2: ("shop bakery A", 384), 4: ("unknown location at coordinates 5.0 5.0", 384)}
    assert models.gazetteer_lookup(rows, known).count() == 4


def test_upserts_keep_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([("c", 1, "old"), ("c", 2, "old"), ("d", 1, "old")], "collection string, doc_id int, v string")
    new = spark.createDataFrame([("c", 1, "a", 1), ("c", 1, "b", 2), ("c", 3, "new", 1)], "collection string, doc_id int, v string, at int")
    got = {(r["collection"], r["doc_id"]): r["v"] for r in store.upsert_vectors(old, new, "at").collect()}
    assert got == {("c", 1): "b", ("c", 2): "old", ("d", 1): "old", ("c", 3): "new"}
    keyed = spark.createDataFrame([("f", 1), ("g", 2)], "fingerprint string, x int")
    assert [r["fingerprint"] for r in store.exists(keyed, keyed.filter("x = 2")).collect()] == ["g"]
    assert [r["fingerprint"] for r in store.invalidate(keyed, keyed.filter("x = 2")).collect()] == ["f"]


def test_probabilities_of_a_head(spark):
    head = Head(("a", "b"), np.array([[1.0, 0.0, 0.0], [0.0, 2.0, -1.0]]))
    got = one(spark, head.probabilities(F.array(F.lit(3.0), F.lit(1.0))))
    want = np.exp([3.0, 1.0]) / np.exp([3.0, 1.0]).sum()
    assert got == pytest.approx(want.tolist()) and one(spark, head.predicted(F.array(F.lit(3.0), F.lit(1.0)))) == "a"
    assert one(spark, head.predicted(F.array(F.lit(0.0), F.lit(0.5)))) == "a"  # equal scores


def test_vectors_equal_those_of_their_texts_alone(spark):
    texts = [None, "", "Hello", " ", "hello", "b", "Hello", "日本語 text", " "] * 3 + [f"text {i}" for i in range(2 * models.AT_ONCE + 7)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", models.infer("embedding", F.col("t")).alias("v")).collect()
    assert len(rows) == len(texts)
    for i, v in rows:
        alone = models.hashed_vectors([texts[i]])[0]
        assert v is None if alone is None else v == alone.astype(np.float32).tolist()


def test_posts_look_their_words_up_once(spark):
    posts = spark.createDataFrame([(1, "so sad", "2024-01-02T03:04:05")], "post_id long, caption string, timestamp string")
    plan = models.enrich_posts(posts, ("sentiment",)).select("sentiment.label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") <= 3
