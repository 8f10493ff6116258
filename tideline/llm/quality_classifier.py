"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of rates and logarithms. Rates are smoothed by pseudo-counts, so that short texts sit
near the middle rather than at the ends. Class means and covariances come from sums that Spark aggregates over
all labelled training rows (nothing of a row reaches the driver); the covariance of class k is shrunk twice,
``(1-b) * ((1-a) * S_k + a * S) + b * mean variance * I`` with ``a = pooling`` and ``b = ridge``. The model keeps
the inverse Cholesky factors, so the score of a row is two small matrix products: half the difference of its
Mahalanobis distances, the log-determinants and the log prior, through the logistic function.

Statistics are made once and written to the shared folder; fitting and scoring read them.

Defined cases: null, empty and blank texts are all-zero counts and get a score; labels that are null or neither
0 nor 1 are no labels; a document labelled twice counts with its greatest label; rows with a null id are scored
and are not held out; repeated rows are scored each; if a class has no training rows, every score is the share
of label 1 (0.5 without labels); extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm.common import table, written
from tideline.llm.quality_rules import STOP_WORDS

FOLDS, THRESHOLD = 5, 0.3
POOLING, RIDGE = 0.1, 0.02
STOPS = frozenset(w.encode() for w in STOP_WORDS)
UPPER, DIGITS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"
#: Pseudo-words of a typical text that smooth the rates.
PRIOR = 15.0
FEATURES = ("log_words", "word_bytes", "symbols", "bangs", "upper", "digits", "distinct", "same_next", "stop_words", "line_repeats", "marks", "log_longest")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    lower = raw.lower().split()
    rate = lambda count, usual: (count + usual * PRIOR) / (n + PRIOR)
    without = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    longest = max(map(len, words), default=0)
    return [
        math.log1p(n),
        math.log(rate(size - without(b" \n\t\r\x0b\x0c"), 5.5)),
        math.sqrt(rate(without(SYMBOLS), 0.0)),
        math.sqrt(rate(raw.count(b"!"), 0.0)),
        math.sqrt(rate(without(UPPER), 0.12)),
        math.sqrt(rate(without(DIGITS), 0.0)),
        len(set(words)) / (n + 1.0) ** 0.8,
        math.sqrt(rate(sum(map(eq, words[1:], words)), 0.0)),
        rate(sum(map(STOPS.__contains__, lower)), 0.25),
        (len(lines) - len(set(lines)) + 0.0) / (len(lines) + 2.0),
        math.sqrt(rate(without(b".,;:"), 0.15)),
        math.log1p(longest),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and a column per feature."""

    def run(batches):
        for batch in batches:
            values = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class, feature, feature: inverses of the Cholesky factors
    offset: float  # log prior and log-determinants
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.offset + 0.5 * (far[0] - far[1]), -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, pooling: float = POOLING, ridge: float = RIDGE) -> Discriminant:
    """``labels`` (``doc_id label``) of the training rows; two rows of sums reach the driver."""
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.join(labels, "doc_id")
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in pairs]
    got = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    n = {k: got[k]["n"] if k in got else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        none = np.zeros((0, p))
        return Discriminant(none, none, 0.0, n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5)
    means, scatter = [], []
    for k in (0, 1):
        m = np.array([got[k][f"s_{i}"] for i in range(p)]) / n[k]
        s = np.zeros((p, p))
        for i, j in pairs:
            s[i, j] = s[j, i] = got[k][f"p_{i}_{j}"] / n[k] - m[i] * m[j]
        means.append(m)
        scatter.append(s)
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))  # shrink towards equal variances of scaled features
    factors, logs = [], []
    for s in scatter:
        c = ((1 - pooling) * s + pooling * pooled) / np.outer(scale, scale)
        c = (1 - ridge) * c + ridge * np.trace(c) / p * np.eye(p) + 1e-9 * np.eye(p)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / scale)
        logs.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), math.log(n[1] / n[0]) + 0.5 * (logs[0] - logs[1]), n[1] / (n[0] + n[1]))


def score(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(stats, labels.filter(~held_out(F.col("doc_id"))))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
