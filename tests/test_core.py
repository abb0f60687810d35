import random

from tallyloom.operators import fill
from tallyloom.operators.graph import connected_components
from tallyloom.operators.skew import pairs_across, pairs_within, salted_join


def components(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        p[max(f(a), f(b))] = min(f(a), f(b))
    return {x: f(x) for x in list(p)}


def test_components_equal_union_find(spark):
    random.seed(3)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(80)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, edges[0], (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_pairs_within_blocks(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(40)], "id long, k long, c long")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3}
    assert {tuple(r) for r in pairs_within(df, ["k"], "id", block=4).collect()} == want
    got = [tuple(r) for r in pairs_across(df, ["k"], "id", "c", block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a % 2 != b % 2}


COLS = "row_id long, denom_version string, foia_row long, run_year int, athr_id string, true_exposure double, fold int, n int"
PLACE, YEAR = [["place"]], [["athr_id", "denom_version", "run_year"]]


def tables(spark, rows):
    df = spark.createDataFrame([(*r, r[0] % 3, 1) for r in rows], COLS)
    return df, spark.createDataFrame([("A",), ("B",), ("A",), (None,)], "athr_id string")


def filled(spark, rows):
    out = fill.fill_predictions(*tables(spark, rows), id_by=PLACE, exposure_by=YEAR)
    assert out.count() == len(rows)
    return out, sorted(map(tuple, fill.filled_cells(out).collect()))


def test_fill_rules(spark):
    nan = float("nan")
    rows = [
        (1, "all", 1, 2010, "A", 0.12),
        (2, "all", 1, 2010, None, 0.12),  # id from the place
        (3, "all", 1, 2010, "NA", -9.0),  # id and exposure
        (4, "all", 1, 2012, "A", None),  # nearest years agree
        (5, "all", 1, 2014, "A", 0.12000001),
        (6, "all", 1, 2016, "A", nan),  # a year at the edge has one neighbour and stays open
        (7, "hc", 1, 2010, "A", None),  # another version
        (8, "all", 2, 2010, "A", 0.12),
        (9, "all", 2, 2010, "B", 0.5),
        (10, "all", 2, 2010, "?", 0.5),  # ids contradict
        (11, "all", 3, 2011, "B", 0.3),
        (12, "all", 3, 2011, "B", 0.4),
        (13, "all", 3, 2011, "B", 9999.0),  # exposures contradict, no fallback
        (14, "all", None, 2011, None, 0.4),
        (15, "all", 4, 2011, "ZZ", None),  # no author
        (15, "all", 4, 2011, "ZZ", None),
        (16, "all", 1, 2011, "A", 0.0),
    ]
    _, cells = filled(spark, rows)
    assert cells == [(2, "athr_id", "A"), (3, "athr_id", "A"), (3, "true_exposure", "0.1200")]
    out, cells = filled(spark, [r for r in rows if r[0] != 16])
    assert (4, "true_exposure", "0.1200") in cells
    by = {r.row_id: r for r in out.collect()}
    assert by[4].true_exposure_source == "adjacent" and by[3].true_exposure_source == "dependency" and by[13].true_exposure_source == "missing"
    assert by[15].athr_id_source == "missing" and by[1].athr_id_source == "observed" and by[1].n == 1


def test_fill_empty(spark):
    assert filled(spark, [])[1] == []
    assert fill.fill_predictions(*tables(spark, [])).count() == 0


def test_determinants_are_mined(spark):
    # a place has one author in each version; an exposure is the author's of a version and year, but for one contradiction
    rows = [(i, "all" if i % 2 else "hc", i % 10 // 2, 2010 + i % 4, "A" if i % 10 < 6 else "B", (i % 2 * 4 + i % 4 + (i % 10 < 6)) / 50) for i in range(400)]
    rows[7] = (*rows[7][:5], 0.99)
    rows += [(1000, "all", 0, 2010, None, None), (1001, None, 0, 2010, None, None)]
    df, authors = tables(spark, rows)
    known = fill.with_authors(df, authors)
    report = {tuple(r.determinant): r for r in fill.mine_dependencies(known, fill.EXPOSURE_UNITS, "__x").collect()}
    assert len(report) == 14 and not report[("athr_id",)].holds and report[("run_year",)].groups == 4
    groups = {}
    for r in rows[:400]:
        groups.setdefault((r[4], r[1], r[3]), []).append(r[5])
    good = report[("athr_id", "denom_version", "run_year")]
    assert (good.records, good.groups, good.with_company) == (400, len(groups), 400)
    assert good.agreeing == sum(len(v) for v in groups.values() if len(set(v)) == 1)
    assert fill.minimal(fill.mine_dependencies(known, fill.ID_UNITS, "__id")) == PLACE
    cells = [tuple(r) for r in fill.filled_cells(fill.fill_predictions(df, authors)).collect()]
    assert (1000, "athr_id", "A") in cells and not any(c[0] == 1001 for c in cells)


def test_left_join_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "id long, k long")
    sizes = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    names = spark.createDataFrame([(1, "one"), (5, "five")], "k long, name string")
    got = salted_join(rows, names, ["k"], size="n", spread_by=["id"], hot=5, sizes=sizes, how="left").collect()
    assert sorted((r.id, r.k, r.name) for r in got) == sorted(((i, None if i % 3 == 0 else i % 2, "one" if i % 3 and i % 2 else None) for i in range(60)))
