"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import pipeline

STAGES = pipeline.STAGES
#: Hashing, model fitting and suffix sorting have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read back."""
    return pipeline.run(spark, sf_dir, STAGES)
