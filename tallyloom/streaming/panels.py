"""Incremental panels with Structured Streaming: counts and sums by key and period as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.runtime import shared_dir


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of those already there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def period_panel(stream: DataFrame, keys: list[str], time: str, value: str, *, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """(keys..., period_start, n, total): closed periods; rows later than `late` after their period are left out.

    The watermark bounds the state to the periods that may still change.
    """
    s = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(*keys, F.window("__t", period)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*keys, F.col("window.start").alias("period_start"), "n", "total")


def start(panel: DataFrame, out: str, *, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Writes the panel to Parquet with its checkpoint in the shared folder; once takes what is there and stops."""
    w = panel.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{shared_dir(panel.sparkSession)}/streams/{out.strip('/').replace('/', '_')}").option("path", out)
    return (w.trigger(availableNow=True) if once else w).start()
