"""Session settings and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and everything runs on one machine, as in tests, a temporary folder is made and kept for the
    session; on a cluster, where each executor would write to its own disk, this is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.conf.get("spark.tallyloom.shared", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.tallyloom.shared", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back.

    Cuts the lineage; unlike localCheckpoint the files outlive any executor. The table is deleted with the shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *, at_least: int | None = None) -> DataFrame:
    """Redistributes rows evenly when the scan gives fewer tasks than the cluster has cores.

    Expensive per-row Python work on a few large input files would otherwise leave cores idle.
    """
    spark = df.sparkSession
    want = at_least or spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
