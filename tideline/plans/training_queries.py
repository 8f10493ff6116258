"""Queries over splits with whole groups, and a trained head."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.operators import evaluation as E, training
from tideline.sources import tables
from tideline.sources.adapters import EVENTS_SQL, emotion_events, table


def split_events(spark, sf_dir):
    """Events of a subject and week as a group, by label."""
    e = emotion_events(spark, sf_dir).withColumn("group", F.concat_ws(":", "subject_id", F.floor(F.col("us") / 604_800_000_000)))
    return E.stratified_group_split(e, "group", "label")


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return E.stratified_group_split(e, "vec_id", "label")


def head_predictions(spark, sf_dir):
    """A head trained on the training part, promoted if it passes on the other two, and the labels that the promoted one
    gives to all vectors (none without)."""
    rows = tables.cut(vectors(spark, sf_dir))
    part = lambda name: rows.filter(F.col("split") == name)
    classes = tuple(r["label"] for r in rows.select("label").distinct().orderBy("label").collect())  # the labels of a task
    head = training.train_head(part("train"), "embedding", "label", classes, decay=1e-2, tolerance=1e-4)
    path = f"{tables.scratch(spark)}/heads-{uuid.uuid4().hex}"
    training.promote(spark, path, "label", head, part("validation"), part("test"), "embedding", "label")
    best = training.current(spark, path, "label")
    predicted = best.predicted(F.col("embedding")) if best else F.lit(None).cast("string")
    return rows.select("vec_id", "label", "split", predicted.alias("predicted"))


QUERIES = {
    "stratified_group_split": lambda s, d: split_events(s, d).select("subject_id", "seq", "label", "group", "split"),
    "stratified_shares": lambda s, d: split_events(s, d).groupBy("label", "split").agg(F.count("*").alias("n")),
    "head_predictions": head_predictions,
}
SPLIT_SQL = f"""{EVENTS_SQL}, e AS (SELECT *, subject_id || ':' || us // 604800000000 AS grp FROM ev), c AS (SELECT grp, label, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT grp, arg_min(label, lpad(CAST(1000000000 - n AS VARCHAR), 10, '0') || label) AS main, CAST(sum(n) AS BIGINT) AS n, md5('42:' || grp) AS h FROM c GROUP BY grp),
q AS (SELECT *, sum(n) OVER (PARTITION BY main ORDER BY h, grp ROWS UNBOUNDED PRECEDING) - n AS b, sum(n) OVER (PARTITION BY main) AS t FROM g),
sp AS (SELECT e.subject_id, e.seq, e.label, grp AS "group", CASE WHEN (2 * b + n) * 100 < 160 * t THEN 'train' WHEN (2 * b + n) * 100 < 180 * t THEN 'validation' ELSE 'test' END AS split FROM e JOIN q USING (grp))"""
ORACLES = {
    "stratified_group_split": f"WITH {SPLIT_SQL} SELECT * FROM sp",
    "stratified_shares": f"WITH {SPLIT_SQL} SELECT label, split, count(*) AS n FROM sp GROUP BY ALL",
}
