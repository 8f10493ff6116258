"""Pluggable inference: named functions over columns, with deterministic stand-ins for models that aren't here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from tideline.functions.text import lexicon_sentiment, location_text, once, roll_up, sentiment_record

#: Words of our own choice that stand in for a classifier of recovery dimensions; register a model for real use.
CHIME_WORDS = {
    "Connectedness": ("friend", "family", "together", "community", "support"),
    "Hope": ("hope", "future", "dream", "believe", "better"),
    "Identity": ("myself", "proud", "strong", "identity", "self"),
    "Meaning": ("meaning", "purpose", "faith", "grateful", "life"),
    "Empowerment": ("control", "decide", "power", "choice", "learn"),
}
DIMENSIONS = 384


def text_sentiment(text: Column) -> Column:
    """Label and score; blank text is neutral with score 1."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    rec = once(lexicon_sentiment(text), sentiment_record)
    return F.when(blank, F.struct(F.lit("neutral").alias("label"), F.lit(1.0).alias("score"))).otherwise(F.struct(rec["label"].alias("label"), rec["score"].alias("score")))


def chime(text: Column) -> Column:
    """The dimension with most distinct words and its share; Uncategorized and 0 without any."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"))
    hits = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in CHIME_WORDS.items()}
    total = sum(hits.values(), F.lit(0))
    best = F.array_max(F.array(*(F.struct(h.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, h) in enumerate(hits.items()))))
    return F.when(total == 0, F.struct(F.lit("Uncategorized").alias("label"), F.lit(0.0).alias("score"))).otherwise(F.struct(best["k"].alias("label"), F.round(best["n"] / total, 4).alias("score")))


def hashed_rows(texts: list[str | None], size: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of the character trigrams of each text as rows scaled to length one, and which texts are blank."""
    padded = [f" {t.lower().strip()} " if t and t.strip() else "" for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    whole = np.flatnonzero(row[2:] == row[:-2])
    h = (codes[whole] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[whole + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[whole + 2] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    cell = row[whole] * size + (h % np.uint64(size)).astype(np.int64)
    out = np.bincount(cell, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * size).reshape(len(texts), size)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1.0), np.array([not p for p in padded], bool)


def hashed_vectors(texts: list[str | None], size: int = DIMENSIONS) -> list[np.ndarray | None]:
    """The rows of ``hashed_rows``; null for blank text."""
    return [None if blank else v for v, blank in zip(*hashed_rows(texts, size), strict=True)]


#: Texts that are hashed at a time.
AT_ONCE = 1000


VECTOR = pa.list_(pa.field("element", pa.float32()))


def embedding(text: Column) -> Column:
    """Vectors of texts. A batch hashes each of its distinct texts once and deals the vectors out as Arrow arrays, without
    an object for a row."""

    def hashed(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode(null_encoding="encode")
        distinct, parts = coded.dictionary.to_pylist(), [pa.array([], VECTOR)]
        for i in range(0, len(distinct), AT_ONCE):
            rows, blank = hashed_rows(distinct[i : i + AT_ONCE])
            starts = pa.array(np.arange(0, rows.size + 1, DIMENSIONS, dtype=np.int32))
            parts.append(pa.ListArray.from_arrays(starts, pa.array(rows.ravel().astype(np.float32)), VECTOR, mask=pa.array(blank)))
        return pa.concat_arrays(parts).take(coded.indices)

    return F.arrow_udf(hashed, T.ArrayType(T.FloatType()))(text)


#: Characters that a classifier of emotions reads.
READ = 512


def rolled_up(emotions: Column) -> Column:
    """Positive, negative and neutral (four decimals) of an array of emotions (label, score); null of none."""
    of = lambda c: F.aggregate(emotions, F.lit(0.0), lambda a, e: a + F.when(roll_up(e["label"]) == c, F.coalesce(e["score"], F.lit(0.0))).otherwise(0.0))
    return F.when(emotions.isNotNull(), F.struct(*(F.round(of(c), 4).alias(c) for c in ("positive", "negative", "neutral"))))


def text_scores(text: Column) -> Column:
    """Classes of a text by the model of emotions; by the lexicon where it gives none."""
    return F.coalesce(rolled_up(infer("emotions", F.left(text, F.lit(READ)))), lexicon_sentiment(text))


_REGISTRY: dict[str, Callable[..., Column]] = {
    "sentiment": text_sentiment,
    "chime": chime,
    "embedding": embedding,
    "emotions": lambda text: F.lit(None).cast("array<struct<label:string,score:double>>"),
    "aspects": lambda text: F.array().cast("array<struct<aspect:string,label:string,score:double>>"),
    "caption": lambda image: F.lit(None).cast("string"),
    "scene": lambda image: F.array().cast("array<struct<scene:string,score:double>>"),
    "face": lambda image: F.struct(F.lit(0.0).alias("positive"), F.lit(1.0).alias("neutral"), F.lit(0.0).alias("negative")),
    "transcript": lambda audio: F.lit(None).cast("string"),
}


def register(name: str, function: Callable[..., Column]) -> None:
    _REGISTRY[name] = function


def infer(name: str, *columns: Column) -> Column:
    if name not in _REGISTRY:
        raise KeyError(f"no model named {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](*columns)


def enrich_posts(posts, models=("sentiment", "chime", "embedding")):
    """Posts with a column per model over their caption, and ``ts`` of their ISO ``timestamp``, which is in UTC unless it
    says otherwise."""
    return posts.withColumns({m: infer(m, F.col("caption")) for m in models} | {"ts": F.try_to_timestamp("timestamp")})


def gazetteer_lookup(rows, gazetteer):
    """Reverse geocoding against a table (``lat lon`` and more) by coordinates of five decimals, each distinct place looked
    up once; of several entries at a place the least one counts."""
    near = lambda: (F.round("lat", 5).alias("glat"), F.round("lon", 5).alias("glon"))
    kept = [c for c in gazetteer.columns if c not in ("lat", "lon")]
    known = gazetteer.select(*near(), F.struct(*kept).alias("g")).groupBy("glat", "glon").agg(F.min("g").alias("g"))
    found = rows.select(*near()).distinct().join(known, ["glat", "glon"], "left").select("glat", "glon", "g.*")
    at = rows.withColumns({"glat": F.round("lat", 5), "glon": F.round("lon", 5)})
    return at.join(found, at["glat"].eqNullSafe(found["glat"]) & at["glon"].eqNullSafe(found["glon"]), "left").drop("glat", "glon")


def enrich_locations(rows, gazetteer):
    """Rows (``lat lon``) with the entry (``category kind name``) of the gazetteer, ``location_text`` and its vector."""
    found = gazetteer_lookup(rows, gazetteer)
    found = found.withColumn("location_text", location_text(*(F.col(c) for c in ("category", "kind", "name", "lat", "lon"))))
    return found.withColumn("location_embedding", infer("embedding", F.col("location_text")))
