"""A corpus from raw documents to packed token sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. No stage can be put in SQL as a whole (tokenisers, fingerprints), so there
is no ORACLE_SQL; tests/llm holds the stages against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.queries import STAGES, run_stages

ORACLE_SQL: str | None = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, sf_dir, STAGES)
