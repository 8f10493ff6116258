"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from tideline.llm.common import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scans", secret_scan.stage),
    ("best_fit_packing", packing.stage),
]
#: Fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
