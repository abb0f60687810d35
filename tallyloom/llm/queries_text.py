"""Problem 8: one form for text that looks the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import canon_text
from tallyloom.runtime import spread


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canon_text.look_alike_pairs(_docs(spark, d))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, canonical) of every document."""
    return canon_text.canonical(_docs(spark, d)).select("doc_id", "canonical")


QUERIES = {"p8_found": p8_found, "p8_canonical": p8_canonical}
SQL: dict[str, str] = {}
