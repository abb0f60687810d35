"""Problem 4: authors of like research."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import clusters
from tallyloom.operators.skew import pairs_within
from tallyloom.runtime import materialize


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return materialize(clusters.cluster(spark.read.parquet(f"{d}/author_text.parquet").select("athr_id", "processed_text"), "athr_id", "processed_text"), "clusters")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(_clusters(spark, d).select(F.col("id").alias("athr_id"), "cluster"), ["cluster"], "athr_id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, size, typical) of every group."""
    return clusters.describe(_clusters(spark, d))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """(athr_id, cluster, degree): the group of each author that has one with others, by its first id, and the author's links."""
    rows = _clusters(spark, d)
    real = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return rows.join(real, "cluster", "left_semi").select(F.col("id").alias("athr_id"), "cluster", "degree")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p4_members": p4_members}
SQL: dict[str, str] = {}
