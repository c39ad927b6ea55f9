"""The corpus pipeline: five stages, each calling one operator of ``corpusbrief.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and read again as the next stage's documents.  All stages but the last return the columns of
``documents``.  ``ORACLE_SQL`` is None: SQL expresses neither the learned stages nor the packing;
``tests/llm/test_pipeline.py`` holds the run against brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusbrief.llm import decontam_automaton, langid_bloom, packing_mt, pii_weak, simhash_golay
from corpusbrief.llm.common import materialize, prep, table

STAGES = [
    ("language_id", langid_bloom.stage),
    ("simhash_near_dedup", simhash_golay.stage),
    ("benchmark_decontamination", decontam_automaton.stage),
    ("pii", pii_weak.stage),
    ("best_fit_packing", packing_mt.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        prep(spark)
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
