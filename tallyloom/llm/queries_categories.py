"""Problem 1: typed categories to the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import categories
from tallyloom.runtime import spread


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{d}/category_file.parquet").select("entry_id", "category"))
    return categories.map_values(rows, spark.read.parquet(f"{d}/categories.parquet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).filter("how not in ('exact', 'blank')").select("entry_id", "category_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return categories.unmatched(_mapped(spark, d))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
SQL: dict[str, str] = {}
