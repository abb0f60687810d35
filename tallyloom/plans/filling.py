"""Problem 2: filling missing values from similar records."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import fill


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/ridge_vs_knn.parquet").select("row_id", "denom_version", "foia_row", "run_year", "fold", "athr_id", "true_exposure")
    return rows, spark.read.parquet(f"{d}/author_text.parquet").select("athr_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return fill.filled_cells(fill.fill_predictions(*_tables(spark, d)))


def p2_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its filled values and their sources."""
    return fill.fill_predictions(*_tables(spark, d)).select("row_id", F.col("athr_id_filled"), "athr_id_source", F.format_string("%.4f", "true_exposure_filled").alias("true_exposure_filled"), "true_exposure_source").withColumn("true_exposure_filled", F.when(F.col("true_exposure_source") != "missing", F.col("true_exposure_filled")))


def p2_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate determinant of both fields, and whether it holds on the complete records."""
    return fill.dependency_report(*_tables(spark, d))


# states the rules for these columns by themselves: no mining, each open cell looks up its own place, year and neighbours
_BASE = """
with author as (select distinct athr_id from author_text where athr_id is not null),
cell as (select row_id, denom_version, foia_row, run_year, fold, athr_id raw_id, case when athr_id in (select athr_id from author) then athr_id end id,
  case when not isnan(true_exposure) and true_exposure >= 0 and true_exposure <= 1 then round(true_exposure, 4) end x from ridge_vs_knn),
position as (select denom_version, foia_row, any_value(id) id from cell where id is not null and denom_version is not null and foia_row is not null group by 1, 2 having count(distinct id) = 1),
owned as (select c.*, p.id given, coalesce(c.id, p.id) who from cell c left join position p on p.denom_version = c.denom_version and p.foia_row = c.foia_row),
exposed as (select who, denom_version, run_year, count(distinct x) kinds, any_value(x) x from owned where x is not null and who is not null and denom_version is not null and run_year is not null group by 1, 2, 3),
blank as (select row_id, who, denom_version, run_year from owned where x is null and who is not null and denom_version is not null and run_year is not null),
same as (select b.row_id, e.kinds, e.x from blank b join exposed e using (who, denom_version, run_year)),
near as (select b.row_id, max(e.run_year) filter (e.run_year < b.run_year) earlier, min(e.run_year) filter (e.run_year > b.run_year) later
  from blank b join exposed e using (who, denom_version) where b.row_id not in (select row_id from same) group by 1),
around as (select b.row_id, e.x from near n join blank b using (row_id) join exposed e on e.who = b.who and e.denom_version = b.denom_version and e.run_year = n.earlier
  join exposed f on f.who = b.who and f.denom_version = b.denom_version and f.run_year = n.later where e.kinds = 1 and f.kinds = 1 and e.x = f.x),
given as (select row_id, x, 'dependency' how from same where kinds = 1 union all select row_id, x, 'adjacent' from around),
whole as (select o.*, g.x fill, g.how from owned o left join (select distinct * from given) g using (row_id))
"""


def _report(field: str, value: str, units: dict[str, str]) -> str:
    """SQL of one field's candidates: one group-by a set."""
    sets = [s for k in (1, 2, 3) for s in combinations(units, k)]
    one = """select '{field}' dependent, '{name}' determinant, sum(n)::bigint records, count(*) groups, coalesce(sum(n) filter (n > 1), 0)::bigint with_company,
coalesce(sum(n) filter (n > 1 and kinds = 1), 0)::bigint agreeing from (select count(*) n, count(distinct {value}) kinds from owned where {value} is not null and {known} group by {columns}) having count(*) > 0"""
    columns = {s: list(dict.fromkeys(c for u in s for c in units[u].split())) for s in sets}
    return " union all ".join(one.format(field=field, name="+".join(s), value=value, known=" and ".join(f"{c} is not null" for c in columns[s]), columns=", ".join(columns[s])) for s in sets)


QUERIES = {"p2_found": p2_found, "p2_provenance": p2_provenance, "p2_dependencies": p2_dependencies}
SQL = {
    "p2_found": _BASE + """select row_id, 'athr_id' field_name, given filled_value from whole where id is null and given is not null
union all select row_id, 'true_exposure', printf('%.4f', fill) from whole where x is null and fill is not null""",
    "p2_provenance": _BASE + """select row_id, who athr_id_filled, case when id is not null then 'observed' when given is not null then 'dependency' else 'missing' end athr_id_source,
printf('%.4f', coalesce(x, fill)) true_exposure_filled, case when x is not null then 'observed' else coalesce(how, 'missing') end true_exposure_source from whole""",
    "p2_dependencies": _BASE + "select *, agreeing >= 0.9 * with_company and with_company >= 0.5 * records and with_company > 0 holds from ("
    + _report("athr_id", "id", {"place": "denom_version foia_row", "run_year": "run_year", "fold": "fold"})
    + " union all " + _report("true_exposure", "x", {"athr_id": "who", "denom_version": "denom_version", "run_year": "run_year", "fold": "fold"}) + ")",
}
