"""Content-addressed payloads and keyed vectors as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tideline.sources.tables import cut


def put(existing: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``fingerprint``) added; a fingerprint that is there already keeps its payload."""
    new = rows.dropDuplicates(["fingerprint"])
    return new if existing is None else existing.unionByName(new.join(existing.select("fingerprint"), "fingerprint", "left_anti"))


def exists(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("fingerprint"), "fingerprint", "left_semi")


def invalidate(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("fingerprint"), "fingerprint", "left_anti")


def get_or_compute(store: DataFrame | None, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The payloads of ``wanted``: those in the store, and the others computed once and written."""
    missing = wanted if store is None else wanted.join(store.select("fingerprint"), "fingerprint", "left_anti")
    made = cut(compute(missing.dropDuplicates(["fingerprint"])))
    return made if store is None else store.join(wanted.select("fingerprint"), "fingerprint", "left_semi").unionByName(made)


def upsert_vectors(existing: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Vectors by collection and document: of the new rows of a key the last by ``order`` (a column of them alone), which
    replaces the old one."""
    kept = [c for c in rows.columns if c not in ("collection", "doc_id", order)]
    last = rows.groupBy("collection", "doc_id").agg(F.max_by(F.struct(*kept), order).alias("__row")).select("collection", "doc_id", "__row.*")
    return existing.join(last.select("collection", "doc_id"), ["collection", "doc_id"], "left_anti").unionByName(last)
