"""A corpus pipeline of five operators: each stage reads what the one before it kept, as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaweave.llm import exact_dedup, mixing, packing, quality, simhash
from glossaweave.llm.common import documents, written

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("near-dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL cannot express the trained classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
