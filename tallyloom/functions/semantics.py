"""Missing-value and ordering rules of panel scripts, as column expressions.

A missing number compares as larger than any number, sums of nothing are 0, and every first or last pick names a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gt(c: Column, x) -> Column:
    """c > x, missing counting as above everything."""
    return c.isNull() | (c > x)


def ge(c: Column, x) -> Column:
    return c.isNull() | (c >= x)


def lt(c: Column, x) -> Column:
    """c < x, false for missing."""
    return F.coalesce(c < x, F.lit(False))


def le(c: Column, x) -> Column:
    return F.coalesce(c <= x, F.lit(False))


def drop_if(df: DataFrame, cond: Column) -> DataFrame:
    """Drops the rows where cond is true; rows where it is null stay."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def sum0(c: Column) -> Column:
    """Sum that is 0 over nothing but nulls."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum_if(c: Column, cond: Column) -> Column:
    """Sum over the rows where cond is true; a null cond counts as false."""
    return F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))


def pctile_avg(c: str, p: float) -> Column:
    """Percentile as the order statistic at ceil(np), averaged with the next if np is whole."""
    q = round(1 - p, 10)
    return F.expr(f"(percentile_disc({p}) within group (order by {c}) + percentile_disc({q}) within group (order by {c} desc)) / 2")


def try_date(c: Column) -> Column:
    """Day-month-year first, then ISO; null if neither."""
    return F.coalesce(F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def money(c: Column) -> Column:
    """Number from text with a currency sign and thousands commas; null if it isn't one."""
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def quarter_index(d: Column) -> Column:
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def any_substring(c: Column, words: list[str]) -> Column:
    """True if the text holds one of the words literally; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(w), F.lit(False))
    return out
