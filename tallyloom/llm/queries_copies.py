"""Problem 3: duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import copies


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/training_dataset.parquet").select("record_id", "cleaned_description", "data_source", "label")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.repeats(_records(spark, d))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_records(spark, d)).select("first_record_id", "copies", "label", "source")


# RE2 has no look-around: marks between digits become private-use letters first (twice, as matches share digits).
_KEEP = "s"
for _mark, _code in ((".", ""), (",", ""), ("/", ""), ("-", ""), (":", ""), ("*", ""), ("+", ""), ("_", ""), ("''", ""), ('"', ""), ("(", ""), (")", ""), ("!", "")):
    for _ in range(2):
        _KEEP = f"regexp_replace({_KEEP}, '([\\p{{N}}])[{_mark}]([\\p{{N}}])', '\\1{_code}\\2', 'g')"
_LEAF = "trim(regexp_replace(regexp_replace(lower({}), '[\\s\\p{{Z}}\\pC\\p{{P}}$+<=>^`|~]', ' ', 'g'), ' +', ' ', 'g'))".replace("\\pC", "\\p{{Cc}}\\p{{Cf}}")
_SQL = f"""
with a as (select record_id id, label, data_source src, cleaned_description s from training_dataset where regexp_matches(cleaned_description, '[\\p{{L}}\\p{{N}}]')),
b as (select id, label, case when src is not null then {_LEAF.format('src')} end source, {_KEEP} s from a),
c as (select id, label, source, list_sort(list_filter(list_transform(string_split(regexp_replace(regexp_replace(s, '[\\s\\p{{Z}}][-–—]+[\\s\\p{{Z}}]', ' ; ', 'g'), '[,/|]', ';', 'g'), ';'), lambda x: {_LEAF.format('x')}), lambda x: x <> '')) parts from b),
g as (select label, source, parts, min(id) first_id, count(*) copies from c group by all)
"""
QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}
SQL = {
    "p3_found": _SQL + "select g.first_id first_record_id, c.id record_id from c join g on c.label is not distinct from g.label and c.source is not distinct from g.source and c.parts = g.parts where c.id > g.first_id",
    "p3_collapsed": _SQL + "select first_id first_record_id, copies, cast(label as varchar) label, source from g",
}
