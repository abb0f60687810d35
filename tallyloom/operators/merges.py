"""Joins with contracts: key uniqueness, match codes, and filling from the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, once it is known that no key occurs twice; raises ValueError with one of the keys otherwise."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {keys} is not unique: {twice[0].asDict()}")
    return df


def _on(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k] for k in keys])


def merge(left: DataFrame, right: DataFrame, keys: list[str], *, keep: tuple[int, ...] = (1, 2, 3), expect: tuple[int, ...] | None = None, null_safe: bool = True, code: str = "merge_code") -> DataFrame:
    """Full match of two tables with a column of codes: 1 only left, 2 only right, 3 both.

    keep picks the codes and with them the join that is run (3: inner, 1 and 3: left, 2 and 3: right, 1: anti). expect
    raises ValueError if another code occurs. Keys match null to null unless null_safe is off. Other columns of the same name
    come from the left.
    """
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in keys])
    rk = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.lit(True).alias("__right"))
    lk = left.withColumn("__left", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) if null_safe else F.col(k) == F.col(f"__r_{k}") for k in keys])
    if set(keep) == {1} and expect is None:
        return left.join(rk, cond, "left_anti").withColumn(code, F.lit(1))
    how = "full"
    if expect is None:
        how = {frozenset({3}): "inner", frozenset({1, 3}): "left", frozenset({2, 3}): "right"}.get(frozenset(keep), "full")
    out = lk.join(rk, cond, how).withColumn(code, F.when(F.col("__left").isNull(), 2).when(F.col("__right").isNull(), 1).otherwise(3))
    if expect is not None:
        bad = out.filter(~F.col(code).isin(*expect)).limit(1).collect()
        if bad:
            raise ValueError(f"merge code {bad[0][code]} occurs, expected {expect}")
    for k in keys:
        out = out.withColumn(k, F.when(F.col("__left").isNull(), F.col(f"__r_{k}")).otherwise(F.col(k)))
    return out.filter(F.col(code).isin(*keep)).drop("__left", "__right", *[f"__r_{k}" for k in keys])


def update_merge(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, match_null: bool = False, code: str = "merge_code") -> DataFrame:
    """Fills missing values of the left from the right; codes 1 no match, 3 agrees, 4 filled, 5 conflict (left kept)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(v).alias(f"__v_{v}") for v in values], F.lit(True).alias("__m"))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) if match_null else F.col(k) == F.col(f"__r_{k}") for k in keys])
    out = left.join(r, cond, "left")
    conflict, filled = F.lit(False), F.lit(False)
    for v in values:
        a, b = F.col(v), F.col(f"__v_{v}")
        conflict = conflict | F.coalesce(a.isNotNull() & b.isNotNull() & (a != b), F.lit(False))
        filled = filled | (a.isNull() & b.isNotNull())
    out = out.withColumn(code, F.when(F.col("__m").isNull(), 1).when(conflict, 5).when(filled, 4).otherwise(3))
    for v in values:
        out = out.withColumn(v, F.coalesce(v, f"__v_{v}"))
    return out.drop("__m", *[f"__r_{k}" for k in keys], *[f"__v_{v}" for v in values])


def explain_unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each unmatched left key and each of its columns: the values the right has where all other columns agree."""
    lone = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
    parts = []
    for k in keys:
        others = [o for o in keys if o != k]
        seen = right.groupBy(*others).agg(F.countDistinct(k).alias("n_values"), F.min(k).cast("string").alias("example"))
        parts.append(lone.join(seen, others).select(*keys, F.lit(k).alias("differs_in"), "n_values", "example"))
    return reduce(DataFrame.unionByName, parts)


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; combines before the shuffle instead of sorting whole groups."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)
