"""Filling missing values from functional dependencies mined and verified on the complete records.

Candidate determinants are all small sets of given units (a unit is a column, or columns that mean something only together).
Each is verified on the complete records: how many of the records that have company under one determinant value agree on the
dependent. The smallest sets that hold give dictionaries of those determinant values whose records are unanimous, so a fill
never picks among rivals. What a dictionary leaves open may come from the nearest groups in time. Every filled cell
carries its source.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.skew import salted_join
from tallyloom.runtime import materialize

#: A determinant holds if this share of the complete records with company agrees, and this share of all complete records has company.
LEAST_AGREEMENT, LEAST_SUPPORT = 0.9, 0.5

Units = dict[str, list[str]]
#: What may determine an author: the position in a version's file means something only with its version.
ID_UNITS: Units = {"place": ["denom_version", "foia_row"], "run_year": ["run_year"], "fold": ["fold"]}
#: What may determine an exposure, once authors are filled.
EXPOSURE_UNITS: Units = {"athr_id": ["__who"], "denom_version": ["denom_version"], "run_year": ["run_year"], "fold": ["fold"]}


def mine_dependencies(rows: DataFrame, units: Units, dependent: str, *, most: int = 3, agreement: float = LEAST_AGREEMENT, support: float = LEAST_SUPPORT) -> DataFrame:
    """(determinant array of unit names, records, groups, with_company, agreeing, holds): every set of up to `most` units.

    records are those with determinant and dependent known; with_company those whose determinant value has two or more,
    agreeing those of them whose determinant value has one dependent value only. Equal records are counted together before
    the sets are laid out side by side, so a hot value costs a row a task. Sets without any record have no row.
    """
    columns = list(dict.fromkeys(c for cs in units.values() for c in cs))
    sets = [s for k in range(1, most + 1) for s in combinations(units, k)]
    equal = rows.filter(F.col(dependent).isNotNull()).groupBy(*columns, F.col(dependent).alias("__v")).agg(F.count("*").alias("__n"))
    used = {s: [c for c in columns if any(c in units[u] for u in s)] for s in sets}
    known = lambda s: F.when(F.lit(True) & _known(used[s]), F.struct(F.lit(sets.index(s)).alias("__set"), *[(F.col(c) if c in used[s] else F.lit(None).cast(equal.schema[c].dataType)).alias(c) for c in columns]))
    side = equal.select(F.explode(F.array_compact(F.array(*[known(s) for s in sets]))).alias("__k"), "__v", "__n").select("__k.*", "__v", "__n")
    groups = side.groupBy("__set", *columns).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__n"))
    total = lambda c, n: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    company = F.col("__n") > 1
    out = groups.groupBy("__set").agg(F.sum("__n").alias("records"), F.count("*").alias("groups"), total(company, F.col("__n")).alias("with_company"), total(company & (F.col("__lo") == F.col("__hi")), F.col("__n")).alias("agreeing"))
    names = F.array(*[F.array(*map(F.lit, s)) for s in sets])
    holds = (F.col("agreeing") >= agreement * F.col("with_company")) & (F.col("with_company") >= support * F.col("records")) & (F.col("with_company") > 0)
    return out.select(names[F.col("__set")].alias("determinant"), "records", "groups", "with_company", "agreeing", holds.alias("holds"))


def _known(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def minimal(report: DataFrame) -> list[list[str]]:
    """The determinants that hold and contain no smaller one that does, the one with most agreeing records first.

    A report has a row for each set of units, whatever the size of the table.
    """
    held = sorted(report.filter("holds").collect(), key=lambda r: (len(r.determinant), -r.agreeing, r.determinant))
    out: list[list[str]] = []
    for r in held:
        if not any(set(s) <= set(r.determinant) for s in out):
            out.append(list(r.determinant))
    return out


def dictionary(rows: DataFrame, key: list[str], dependent: str) -> DataFrame:
    """(key..., lo, hi): the smallest and largest known value of each determinant value; unanimous where lo = hi.

    Both are null where no value is known. Rows with a null in the key determine nothing.
    """
    return rows.filter(_known(key)).groupBy(*key).agg(F.min(dependent).alias("lo"), F.max(dependent).alias("hi"), F.count("*").alias("__rows"))


def adjacent(found: DataFrame, key: list[str], time: str) -> DataFrame:
    """found with (value, how): where a determinant value has known values, the one they agree on ('dependency'); where it
    has none, that of the nearest earlier and the nearest later time that have any, if both exist and all agree ('adjacent').
    """
    w = Window.partitionBy(*[c for c in key if c != time]).orderBy(time)  # as many rows as there are times
    span = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    found = found.withColumn("__b", F.last(span, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__a", F.first(span, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    # comparisons with an absent side are null, so a missing side fills nothing
    near = (F.col("__b.lo") == F.col("__b.hi")) & (F.col("__a.lo") == F.col("__a.hi")) & (F.col("__b.lo") == F.col("__a.lo"))
    value = F.when(F.col("lo").isNotNull(), F.when(F.col("lo") == F.col("hi"), F.col("lo"))).when(near, F.col("__b.lo"))
    return found.withColumns({"value": value, "how": F.when(F.col("lo").isNotNull(), "dependency").otherwise("adjacent")}).drop("__b", "__a")


def fill_from(rows: DataFrame, units: Units, dependent: str, row_key: str, *, determinants: list[list[str]] | None = None, time: str | None = None) -> DataFrame:
    """rows with `__fill` and `__how`: what the mined dictionaries give for the dependent, known or not.

    determinants: the unit sets to use, else those minimal() finds. Each dictionary is joined to the rows by a salted left
    join; rows with a null key are spread over the tasks. Of several dictionaries the first that has a value decides.
    """
    if determinants is None:
        determinants = minimal(mine_dependencies(rows, units, dependent))
    out, fills = rows, []
    for i, names in enumerate(determinants):
        key = list(dict.fromkeys(c for u in names for c in units[u]))
        found = dictionary(rows, key, dependent)
        found = adjacent(found, key, time) if time in key else found.withColumns({"value": F.when(F.col("lo") == F.col("hi"), F.col("lo")), "how": F.lit("dependency")})
        found = materialize(found, "dictionary")
        out = salted_join(out, found.filter("value is not null").select(*key, F.struct("value", "how").alias(f"__f{i}")), key, size="__rows", spread_by=[row_key], sizes=found.select(*key, "__rows"), how="left")
        fills.append(f"__f{i}")
    first = F.coalesce(*fills) if fills else F.lit(None).cast(rows.select(F.struct(F.col(dependent).alias("value"), F.lit("").alias("how")).alias("x")).schema["x"].dataType)
    return out.withColumns({"__fill": first["value"], "__how": first["how"]}).drop(*fills)


def real_exposure(c: Column) -> Column:
    """A number in 0..1 rounded to four decimals; null for null, NaN and any code outside the range."""
    return F.when(c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0), F.round(c, 4))


def known_cells(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """rows with `__id`, the id if it is a real author's, and `__x`, the exposure if it is real.

    authors without rows is an empty table of authors: then no id is real.
    """
    real = authors.select(F.col("athr_id").alias("__real")).filter("__real is not null").distinct()
    sizes = materialize(rows.filter("athr_id is not null").groupBy("athr_id").agg(F.count("*").alias("__rows")), "ids")
    real = sizes.join(real, F.col("athr_id") == F.col("__real"), "left_semi").select("athr_id", F.col("athr_id").alias("__id"))
    return salted_join(rows, real, ["athr_id"], size="__rows", spread_by=["row_id"], sizes=sizes, how="left").withColumn("__x", real_exposure(F.col("true_exposure")))


def with_authors(rows: DataFrame, authors: DataFrame, determinants: list[list[str]] | None = None) -> DataFrame:
    """rows with `__id`, `__x`, `__place` (the id their position gives) and `__who` (the author known or filled)."""
    known = materialize(known_cells(rows, authors), "known")
    out = fill_from(known, ID_UNITS, "__id", "row_id", determinants=determinants)
    return materialize(out.withColumn("__who", F.coalesce("__fill", "__id")).withColumnRenamed("__fill", "__place").drop("__how"), "authors")


def fill_predictions(rows: DataFrame, authors: DataFrame, *, id_by: list[list[str]] | None = None, exposure_by: list[list[str]] | None = None) -> DataFrame:
    """Fills athr_id and true_exposure of ridge_vs_knn rows and says where each value is from.

    rows: row_id, denom_version, foia_row, run_year, fold, athr_id, true_exposure and any other columns, which pass unchanged
    (names that begin with two underscores are this operator's own). authors: athr_id of the real authors.

    Adds athr_id_filled, athr_id_source ('observed', 'dependency', 'missing'), true_exposure_filled (four decimals) and
    true_exposure_source ('observed', 'dependency', 'adjacent', 'missing'). The determinants are mined from the complete
    records; id_by and exposure_by, lists of sets of ID_UNITS and EXPOSURE_UNITS, set them instead. In these data an id follows from its
    place (denom_version, foia_row) if all real ids there are one, an exposure from (author, denom_version, run_year) if its
    real values agree to four decimals, or, where that year has none, from the nearest earlier and the nearest later year
    that have any, if all of those agree; a year with values on one side only stays open. Null determinants never fill;
    repeated rows change nothing; an empty table gives an empty table.
    """
    known = with_authors(rows, authors, id_by)
    out = fill_from(known, EXPOSURE_UNITS, "__x", "row_id", determinants=exposure_by, time="run_year")
    took = F.col("__x").isNull() & F.col("__fill").isNotNull()
    columns = {
        "athr_id_filled": F.col("__who"),
        "athr_id_source": F.when(F.col("__place").isNotNull() & ~F.col("athr_id").eqNullSafe(F.col("__place")), "dependency").when(F.col("__who").isNotNull(), "observed").otherwise("missing"),
        "true_exposure_filled": F.coalesce("__x", "__fill"),
        "true_exposure_source": F.when(F.col("__x").isNotNull(), "observed").when(took, F.col("__how")).otherwise("missing"),
    }
    return out.select(*rows.columns, *[c.alias(n) for n, c in columns.items()])


def filled_cells(filled: DataFrame) -> DataFrame:
    """(row_id, field_name, filled_value) of each cell that fill_predictions filled."""
    cells = F.array(
        F.struct(F.lit("athr_id").alias("field_name"), F.when(F.col("athr_id_source") == "dependency", F.col("athr_id_filled")).alias("filled_value")),
        F.struct(F.lit("true_exposure").alias("field_name"), F.when(F.col("true_exposure_source").isin("dependency", "adjacent"), F.format_string("%.4f", "true_exposure_filled")).alias("filled_value")),
    )
    return filled.select("row_id", F.inline(cells)).filter("filled_value is not null")


def dependency_report(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """(dependent, determinant, records, groups, with_company, agreeing, holds) of all candidates; determinant as 'a+b'."""
    known = with_authors(rows, authors)
    ids = mine_dependencies(known, ID_UNITS, "__id").withColumn("dependent", F.lit("athr_id"))
    both = ids.unionByName(mine_dependencies(known, EXPOSURE_UNITS, "__x").withColumn("dependent", F.lit("true_exposure")))
    return both.withColumn("determinant", F.array_join("determinant", "+")).select("dependent", "determinant", "records", "groups", "with_company", "agreeing", "holds")
