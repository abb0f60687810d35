"""Panels: unit by time tables, their repair, and the measures built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.semantics import pctile_avg, sum0


def fill_span(df: DataFrame, unit: list[str], time: str, *, full: bool = False) -> DataFrame:
    """Adds the missing whole-number times of each unit, within its own span or (full) the span of all.

    Other columns of added rows are null. The span of all is one row; rows grow with units times span, as asked.
    """
    span = df.groupBy(*unit).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    if full:
        span = span.drop("__a", "__b").crossJoin(F.broadcast(df.agg(F.min(time).alias("__a"), F.max(time).alias("__b"))))
    spine = span.select(*unit, F.explode(F.sequence("__a", "__b")).alias(time))
    return spine.join(df, [*unit, time], "left")


def carry_forward(c: str, unit: list[str], time: str) -> Column:
    """The last known value up to this time."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))


def carry_back(c: str, unit: list[str], time: str) -> Column:
    return F.first(c, ignorenulls=True).over(Window.partitionBy(*unit).orderBy(time).rowsBetween(0, Window.unboundedFollowing))


def step_change(c: str, unit: list[str], time: str, step: int = 1) -> Column:
    """Difference to exactly the previous period; null across gaps."""
    w = Window.partitionBy(*unit).orderBy(time)
    return F.when(F.col(time) - F.lag(time).over(w) == step, F.col(c) - F.lag(c).over(w))


def sandwich(df: DataFrame, unit: list[str], time: str, c: str) -> DataFrame:
    """Replaces a value between two equal other values by them; flags come from the original values and never touch."""
    w = Window.partitionBy(*unit).orderBy(time)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    df = df.withColumn("__to", F.when((before == after) & ~F.col(c).eqNullSafe(before), before))
    use = F.col("__to").isNotNull() & F.lag(F.col("__to")).over(w).isNull()
    return df.withColumn(c, F.when(use, F.col("__to")).otherwise(F.col(c))).drop("__to")


def trim(df: DataFrame, groups: list[str], c: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Drops the rows outside the group's percentiles; missing values count as above the upper one."""
    cut = df.groupBy(*groups).agg(pctile_avg(c, low).alias("__lo"), pctile_avg(c, high).alias("__hi"))
    return df.join(cut, groups).filter((F.col(c) >= F.col("__lo")) & (F.col(c) <= F.col("__hi"))).drop("__lo", "__hi")


def base_year(c: str, unit: list[str], time: str, base: int) -> Column:
    """The value minus the unit's value in the base period."""
    return F.col(c) - F.max(F.when(F.col(time) == base, F.col(c))).over(Window.partitionBy(*unit))


def shares(df: DataFrame, market: list[str], firm: str, spend: str) -> DataFrame:
    """(market..., firm, spend, share): shares of each firm in its market; 0 spend markets have null shares."""
    by = df.groupBy(*market, firm).agg(sum0(F.col(spend)).alias("spend"))
    total = F.sum("spend").over(Window.partitionBy(*market))
    return by.withColumn("share", F.when(total > 0, F.col("spend") / total))


def concentration(share_table: DataFrame, market: list[str]) -> DataFrame:
    """(market..., hhi): the sum of squared percentage shares."""
    return share_table.groupBy(*market).agg(F.sum((100 * F.col("share")) ** 2).alias("hhi"))


def simulated_delta(share_table: DataFrame, market: list[str], firm: str, a, b) -> DataFrame:
    """(market..., delta_hhi): 2 x share of a x share of b, in squared percentages; 0 where one is absent."""
    of = lambda x: F.coalesce(F.max(F.when(F.col(firm) == x, 100 * F.col("share"))), F.lit(0.0))
    return share_table.groupBy(*market).agg((2 * of(a) * of(b)).alias("delta_hhi"))


def quantile_bins(df: DataFrame, c: str, n: int, name: str = "bin") -> DataFrame:
    """Bins 1..n at averaged percentiles; ties stay together, missing stays missing."""
    cuts = df.agg(*[pctile_avg(c, round(i / n, 6)).alias(f"__q{i}") for i in range(1, n)])
    e = F.lit(1)
    for i in range(1, n):
        e = e + F.when(F.col(c) > F.col(f"__q{i}"), 1).otherwise(0)
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col(c).isNotNull(), e)).drop(*[f"__q{i}" for i in range(1, n)])


def shift_share(spend: DataFrame, unit: str, market: str, amount: str, effects: DataFrame, effect: str, allowed: Column | None = None) -> DataFrame:
    """(unit, exposure, share_sum, total): sum over markets of effect x the market's share in the unit's allowed spending.

    Effects are joined once per market; units without allowed spending drop out. share_sum is the part of the spending in
    markets that have an effect.
    """
    if allowed is not None:
        spend = spend.filter(F.coalesce(allowed, F.lit(False)))
    by = spend.groupBy(unit, market).agg(sum0(F.col(amount)).alias("s"))
    by = by.withColumn("total", F.sum("s").over(Window.partitionBy(unit))).filter("total > 0")
    share = F.col("s") / F.col("total")
    e = F.col(effect)
    return by.join(effects.select(market, effect), market, "left").groupBy(unit).agg(F.coalesce(F.sum(share * e), F.lit(0.0)).alias("exposure"), F.coalesce(F.sum(F.when(e.isNotNull(), share)), F.lit(0.0)).alias("share_sum"), F.max("total").alias("total"))


def shrink(df: DataFrame, b: str = "b", se: str = "se") -> DataFrame:
    """Adds w_eb, b_eb, se_eb: empirical-Bayes shrinkage to the precision-weighted mean. The moments are one row."""
    v = F.col(se) ** 2
    m = df.agg(F.greatest(F.lit(0.0), F.var_samp(b) - F.avg(v)).alias("__t2"), (F.sum(F.col(b) / v) / F.sum(1 / v)).alias("__mu"))
    w = F.col("__t2") / (F.col("__t2") + v)
    df = df.crossJoin(F.broadcast(m)).withColumn("w_eb", w)
    return df.withColumn("b_eb", F.col("w_eb") * F.col(b) + (1 - F.col("w_eb")) * F.col("__mu")).withColumn("se_eb", F.sqrt(F.col("w_eb") * v)).drop("__t2", "__mu")


def settle_values(df: DataFrame, unit: str, time: str, value: str, weight: str, *, reach: int = 5, rounds: int = 3, tie: str = "hash", seed: int = 1) -> DataFrame:
    """(unit, time, value): one value per unit and time where several compete.

    A round keeps, of the competing values, those the unit also has within `reach` periods before and after, failing those
    the ones it has before, failing those after; later rounds see only what is left. Then the value of largest total weight,
    and among equals a hash of (unit, value, seed), or the least value (tie='least').
    """
    rows = df.groupBy(unit, time, value).agg(F.sum(weight).alias("__w"))
    for _ in range(rounds):
        w = Window.partitionBy(unit, value).orderBy(time)
        before = F.coalesce(F.col(time) - F.lag(time).over(w) <= reach, F.lit(False))
        after = F.coalesce(F.lead(time).over(w) - F.col(time) <= reach, F.lit(False))
        rows = rows.withColumn("__s", F.when(before & after, 3).when(before, 2).when(after, 1).otherwise(0))
        rows = rows.withColumn("__m", F.max("__s").over(Window.partitionBy(unit, time))).filter("__s = __m").drop("__s", "__m")
    rows = rows.withColumn("__t", F.sum("__w").over(Window.partitionBy(unit, value)))
    last = F.xxhash64(F.col(unit), F.col(value), F.lit(seed)) if tie == "hash" else F.col(value)
    return rows.groupBy(unit, time).agg(F.min_by(value, F.struct(-F.col("__t"), last, F.col(value))).alias(value))
