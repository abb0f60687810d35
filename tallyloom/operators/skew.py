"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialize


#: A key is hot above HOT rows and above the share 1 / MOST_HOT of all rows, so there are at most MOST_HOT hot keys.
HOT, MOST_HOT = 50_000, 10_000
#: Rows without a key are spread over so many values.
NO_KEY_PARTS = 10_000


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], *, size: str, spread_by: list[str], hot: int = HOT, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Joins rows to the row (or rows) of their key in groups, whose column `size` holds the number of rows of that key.

    A key above the bound is cut into parts of about the bound: its groups are written once a part and its rows spread over
    the parts. The rows learn of hot keys from a broadcast of at most MOST_HOT hashes, at any size of the input. groups is
    written to the shared folder first, as it is read three times; where that would be costly, sizes is a cheap table with the
    same keys and sizes, and groups is read once. how: 'inner' or 'left'. Keys that are null match nothing; a left join
    keeps their rows, spread over the tasks.
    """
    if sizes is None:
        groups = sizes = materialize(groups, "groups")
    total = sizes.agg(F.sum(size)).first()[0] or 0
    bound = max(hot, -(-total // MOST_HOT))
    digest = lambda: F.xxhash64(*[F.col(k) for k in keys])
    parts = lambda c: F.ceil(c / F.lit(bound)).cast("int")
    hot_set = sizes.filter(F.col(size) > bound).groupBy(digest().alias("__hot")).agg(parts(F.max(size)).alias("__parts"))
    hot_set = F.broadcast(hot_set)
    # both sides ask the same set, so two keys of one hash can't part ways
    tag = lambda df: df.withColumn("__k", digest()).join(hot_set, F.col("__k") == F.col("__hot"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop("__k", "__hot")
    salt = F.pmod(F.xxhash64(*spread_by), F.col("__parts")).cast("int")
    if how == "left":
        no_key = F.lit(False)
        for k in keys:
            no_key |= F.col(k).isNull()
        salt = F.when(no_key, -1 - F.pmod(F.xxhash64(*spread_by), F.lit(NO_KEY_PARTS)).cast("int")).otherwise(salt)
    left = tag(rows).withColumn("__salt", salt).drop("__parts")
    right = tag(groups).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def pairs_within(rows: DataFrame, key: list[str], id_: str, *, block: int = 4096) -> DataFrame:
    """(<id>_a, <id>_b): every pair of rows of equal key, smaller id first; for results that are all such pairs.

    A key of many rows is joined in blocks: one side is spread over n / block parts, the other repeated for each, so no task
    holds more than about block rows of one key against the whole. Keys of one row never reach the join; null keys pair with
    nothing.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")
    mine = salted_join(rows.select(*key, id_), sizes, key, size="__n", spread_by=[id_])
    parts = F.ceil(F.col("__n") / block).cast("int")
    part = F.pmod(F.xxhash64(id_), parts).cast("int").alias("__part")
    left = mine.select(F.col(id_).alias(f"{id_}_a"), *[F.col(k) for k in key], part)
    right = mine.select(F.col(id_).alias(f"{id_}_b"), *[F.col(k) for k in key], F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    return left.join(right, [*key, "__part"]).filter(F.col(f"{id_}_a") < F.col(f"{id_}_b")).select(f"{id_}_a", f"{id_}_b")


def pairs_across(rows: DataFrame, key: list[str], id_: str, differ: str, *, block: int = 4096) -> DataFrame:
    """(<id>_a, <id>_b): every pair of rows of equal key that differ in a column, smaller id first.

    The work is the result: classes of rows alike in key and column are counted first, pairs of classes are formed, and only
    their rows meet, in blocks of about block x block, so a class that has a third of all rows is many tasks and its rows
    are never compared with each other. Repeated ids make repeated pairs; a null in key or column pairs with nothing.
    """
    classes = rows.groupBy(*key, differ).agg(F.count("*").alias("__c"))
    many = classes.groupBy(*key).agg(F.count("*").alias("__k")).filter("__k > 1").select(*key)
    classes = classes.join(many, key, "left_semi")
    a = classes.select(*key, F.col(differ).alias("__da"), F.col("__c").alias("__ca"))
    b = classes.select(*key, F.col(differ).alias("__db"), F.col("__c").alias("__cb"))
    pairs = a.join(b, key).filter(F.col("__da") < F.col("__db"))
    pairs = materialize(pairs, "pairs").withColumns({"__pa": F.ceil(F.col("__ca") / block).cast("int"), "__pb": F.ceil(F.col("__cb") / block).cast("int")})
    part = lambda n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [*key, "__da", "__db"]
    left = salted_join(rows.select(*key, id_, F.col(differ).alias("__da")), pairs, [*key, "__da"], size="__ca", spread_by=[id_], sizes=pairs)
    left = left.select(*at, F.col(id_).alias("__a"), part("__pa").alias("__i"), all_of("__pb").alias("__j"))
    right = salted_join(rows.select(*key, id_, F.col(differ).alias("__db")), pairs, [*key, "__db"], size="__cb", spread_by=[id_], sizes=pairs)
    right = right.select(*at, F.col(id_).alias("__b"), part("__pb").alias("__j"), all_of("__pa").alias("__i"))
    both = left.join(right, [*at, "__i", "__j"]).filter("__a <> __b")
    return both.select(F.least("__a", "__b").alias(f"{id_}_a"), F.greatest("__a", "__b").alias(f"{id_}_b"))
