"""Problems 6 and 7: encoding the corpus and packing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import pack, tokenize
from tallyloom.runtime import spread


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, loss_tokens, container_id, segment) of every document."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return pack.pack(tokenize.encode(docs, size_only=True).select("doc_id", F.col("ids").alias("n_tokens")))


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """Containers of instruction data, where all three limits bind: 2,048 tokens, 8 segments and 1,400 loss-bearing tokens.

    The text to its first line or sentence end is the prompt and bears no loss, by its share of the characters.
    """
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    prompt = F.length(F.regexp_extract("text", r"^[^\n.!?]*[\n.!?]?", 0)) / F.greatest(F.length("text"), F.lit(1))
    sized = tokenize.encode(docs.withColumn("prompt", F.coalesce(prompt, F.lit(0.0))), size_only=True)
    sized = sized.select("doc_id", F.col("ids").alias("n_tokens"), F.floor(F.col("ids") * (1 - F.col("prompt"))).cast("int").alias("loss"))
    return pack.pack(sized, segments=8, loss="loss", loss_capacity=1400)


QUERIES = {"p6_ids": p6_ids, "p7_containers": p7_containers, "p7_masked": p7_masked}
SQL: dict[str, str] = {}
