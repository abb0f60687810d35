"""Records equal but for formatting: Merkle-style hashing from normalised leaves to a root.

A record is a node with the ordered children label and source and one unordered child, the description, whose children
are its pieces. Leaves are normalised, their digests sorted at the unordered node, and the root digest groups records;
within a root digest the full normalised structure is compared, so a digest collision can't merge two records. All of it
is built-in expressions, inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.skew import salted_join
from tallyloom.runtime import materialize

# The character classes of the rule. ASCII symbols count as punctuation.
SPACE = r"[\s\p{Z}\p{C}]"
PUNCT = r"[\p{P}$+<=>^`|~]"
SEPARATOR = rf"[;|]|(?<!\p{{N}})[,/]|[,/](?!\p{{N}})|{SPACE}[-–—]+(?={SPACE})"


def leaf(c: Column) -> Column:
    """Lower case, one space for white space and punctuation; a single mark between two digits is content."""
    c = F.regexp_replace(F.lower(c), rf"{SPACE}+", " ")
    c = F.regexp_replace(c, rf"(?<!\p{{N}}){PUNCT}|{PUNCT}(?!\p{{N}})", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def pieces(c: Column) -> Column:
    """The normalised pieces of a description, without empty ones, in the order of their digests.

    The same as leaf() of each piece, but every pattern runs once over the whole text: separators become a control character first.
    """
    c = F.regexp_replace(F.lower(c), rf"{SPACE}+", " ")
    c = F.regexp_replace(c, SEPARATOR, "\x01")
    c = F.regexp_replace(c, rf"(?<!\p{{N}}){PUNCT}|{PUNCT}(?!\p{{N}})", " ")
    c = F.regexp_replace(c, " *\x01[ \x01]*", "\x01")
    c = F.trim(F.regexp_replace(c, "  +", " "))
    got = F.filter(F.transform(F.split(c, "\x01"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(F.array_sort(F.transform(got, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p")))), lambda s: s["p"])


def structure(df: DataFrame, key: str = "record_id", description: str = "cleaned_description", source: str = "data_source", label: str = "label") -> DataFrame:
    """(id, root, label, source, body) of the records whose description has a letter or digit."""
    rows = df.filter(F.col(description).rlike(r"[\p{L}\p{N}]"))
    rows = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), leaf(F.col(source)).alias("source"), pieces(F.col(description)).alias("parts"))
    root = F.xxhash64(F.coalesce(F.col("label").cast("string"), F.lit("\x00")), F.coalesce("source", F.lit("\x00")), F.transform("parts", lambda p: F.xxhash64(p)))
    null = F.lit("\x00")
    return rows.select("id", root.alias("root"), F.coalesce(F.col("label").cast("string"), null).alias("label"), F.coalesce("source", null).alias("source"), F.array_join("parts", "\x01").alias("body"))


NODE = ["root", "label", "source", "body"]


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct record: the smallest id and the number of copies. Combines before the shuffle."""
    return rows.groupBy(*NODE).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collapse(df: DataFrame, **names: str) -> DataFrame:
    """(first_record_id, copies, label, source, pieces): each distinct record once, with its number of copies.

    Null equals null in label and source; records whose description is null or has no letter or digit are left out
    (they are no records to compare). Order of rows, repeated ids and extra columns don't matter.
    """
    bare = lambda c: F.when(F.col(c) != "\x00", F.col(c)).alias(c)
    return groups(structure(df, **names)).select(F.col("first_id").alias("first_record_id"), "copies", bare("label"), bare("source"), F.regexp_replace("body", "\x01", "; ").alias("pieces"))


def repeats(df: DataFrame, **names: str) -> DataFrame:
    """(first_record_id, record_id): each record that repeats one with a smaller id; hot groups are salted."""
    rows = materialize(structure(df, **names), "records")
    many = groups(rows).filter("copies > 1")
    return salted_join(rows, many, NODE, size="copies", spread_by=["id"]).filter("id > first_id").select(F.col("first_id").alias("first_record_id"), F.col("id").alias("record_id"))
