"""Ranks and running counts over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import materialize


def running_counts(df: DataFrame, groups: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """(groups..., value, <name>, before_<name>): per distinct value the aggregates and their sums over smaller values.

    The values are counted first, then cut into ranges; sums run within a range, and the totals of the ranges before are added,
    so no task holds a whole group. The ranges are written once, as sampling would cut them differently on a second run.
    Missing values are left out.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[e.alias(n) for n, e in counts.items()])
    c = materialize(c.repartitionByRange(*groups, value).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = c.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in counts})
    totals = c.groupBy(*groups, "__part").agg(*[F.sum(n).alias(f"__t_{n}") for n in counts])
    wp = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select(*groups, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(wp), F.lit(0)).alias(f"__o_{n}") for n in counts])
    out = run.join(totals, [*groups, "__part"])
    return out.select(*groups, value, *counts, *[(F.col(f"before_{n}") + F.col(f"__o_{n}")).alias(f"before_{n}") for n in counts])


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the average rank (from 1) of the value in its group; ties share theirs, missing values have none."""
    r = running_counts(df, groups, value, {"n": F.count("*")}).select(*groups, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))
    return df.join(r, [*groups, value], "left")
