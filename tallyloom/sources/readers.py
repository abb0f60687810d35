"""Sources: delimited text, workbooks, Stata files, nested JSON, XML, rule files; all columns come in as text and are cast later."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.semantics import money, try_date

#: The columns every purchase source is brought to.
STANDARD = ("product_desc", "supplier", "supplier_id", "sku", "price", "qty", "spend", "unit", "purchaser", "fund_id", "purchase_id", "date", "funder")
MAX_DRIVER_ROWS = 5_000_000


def delimited(spark: SparkSession, path: str, *, sep: str = ",", quotes: bool = True, header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """Text columns of one or many files; quoted fields may hold line breaks. Header names come out in lower case."""
    r = spark.read.option("header", header).option("sep", sep).option("inferSchema", False).option("encoding", "UTF-8")
    r = r.option("multiLine", True).option("quote", '"').option("escape", '"') if quotes else r.option("quote", "")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def two_fields(spark: SparkSession, path: str, names: tuple[str, str], *, above: int = 5, header: bool = True) -> DataFrame:
    """Damaged two-column files: each line is parted at its first comma; the header and lines that are blank or begin with @ are skipped.

    Outer quotes go; the words null, none, na and nan and texts of `above` characters or fewer count as missing and drop the line.
    """
    # a separator that no text has: the line is one field
    line = spark.read.schema("value string").option("header", header).option("sep", "\x01").option("quote", "").csv(path).filter((F.trim("value") != "") & ~F.col("value").startswith("@") & F.col("value").contains(","))
    part = F.split("value", ",", 2)
    bare = lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', "")
    return line.select(bare(part[0]).alias(names[0]), bare(part[1]).alias(names[1])).filter((F.length(names[1]) > above) & ~F.lower(names[1]).isin("null", "none", "na", "nan"))


def workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """An Excel sheet as text columns. Needs an Excel engine for pandas; ImportError says so if there is none."""
    pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in pdf.columns]))


def stata(spark: SparkSession, path: str, out: str, *, columns: list[str] | None = None, chunk: int = 500_000) -> DataFrame:
    """A Stata file written once as Parquet, chunk by chunk, so the driver holds one chunk; then read from there."""
    with pd.read_stata(path, columns=columns, chunksize=chunk, convert_categoricals=False) as reader:
        for i, pdf in enumerate(reader):
            spark.createDataFrame(pdf).write.mode("overwrite" if i == 0 else "append").parquet(out)
    return spark.read.parquet(out)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document per file, with the year of its folder (the last four-digit part of the path)."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    df = (r.schema(schema) if schema else r).json(path)
    return df.withColumn("folder_year", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})/[^/]*$", 1).try_cast("int"))


def nested_table(df: DataFrame, key: str, array: str, fields: dict[str, str]) -> DataFrame:
    """One row per element of an array of structs (one with nulls for an empty array): key, position, and fields name -> path."""
    return df.select(F.col(key), F.posexplode_outer(array).alias("position", "__e")).select(key, "position", *[F.col(f"__e.{p}").alias(n) for n, p in fields.items()])


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def rule_file(path: str) -> dict:
    """The parsed form of a YAML rule file."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


READERS = {".csv": lambda s, p: delimited(s, p), ".tsv": lambda s, p: delimited(s, p, sep="\t", quotes=False), ".parquet": lambda s, p: s.read.parquet(p), ".json": lambda s, p: json_documents(s, p), ".xlsx": workbook, ".xls": workbook, ".dta": lambda s, p: stata(s, p, p + ".parquet")}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a file's suffix; ValueError for an unknown one."""
    suffix = Path(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix!r}")
    return READERS[suffix](spark, path)


def standardize(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df in the STANDARD columns by a mapping standard -> source; absent ones are null, blank texts are null, numbers and dates cast."""
    text = lambda c: F.nullif(F.trim(F.col(mapping[c]).cast("string")), F.lit("")) if mapping.get(c) in df.columns else F.lit(None).cast("string")
    cast: dict[str, Column] = {c: text(c) for c in STANDARD}
    for c in ("price", "qty", "spend"):
        cast[c] = money(cast[c])
    cast["date"] = try_date(cast["date"])
    cast["supplier_id"] = F.ltrim(cast["supplier_id"], F.lit("0"))
    return df.select(*[cast[c].alias(c) for c in STANDARD])


def missing_shards(observed: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """The numbers of first..last that no row has."""
    return observed.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(column)).join(observed.select(column).distinct(), column, "left_anti")


def write_by_group(df: DataFrame, path: str, column: str) -> None:
    """One folder per value of the column."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
