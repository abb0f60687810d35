"""Problem 5: listings of the same product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import products
from tallyloom.operators.skew import pairs_within
from tallyloom.runtime import materialize, spread


def _read(spark: SparkSession, d: str) -> DataFrame:
    return products.attributes(spread(spark.read.parquet(f"{d}/catalog_listings.parquet").select("listing_id", "cleaned_description", "category")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(products.grouped(_read(spark, d)).select("listing_id", "product"), "listings")
    return pairs_within(rows, ["product"], "listing_id")


def p5_products(spark: SparkSession, d: str) -> DataFrame:
    """One row per product: its attributes, how many listings state it and the first of them."""
    return products.grouped(_read(spark, d)).groupBy("product", *products.ATTRIBUTES).agg(F.count("*").alias("n_listings"), F.min("listing_id").alias("first_listing_id")).drop("product")


def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """The listings in which no kind or no maker was found."""
    return products.unread(_read(spark, d))


QUERIES = {"p5_found": p5_found, "p5_products": p5_products, "p5_unread": p5_unread}
SQL: dict[str, str] = {}
