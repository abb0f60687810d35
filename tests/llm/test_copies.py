from tallyloom.llm import copies

COLS = "record_id long, cleaned_description string, data_source string, label int, root string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    return sorted(map(tuple, copies.repeats(df).collect()))


def test_formatting_and_order(spark):
    rows = [
        (1, "glass gauge; quartz hinge; 7.5 g; ref k33", "uni_north", 1),
        (2, "REF K33 / Quartz-Hinge / glass  gauge! / [7.5 G]", "Uni North", 1),
        (3, ". 7.5 g - glass gauge - quartz hinge - ref k33 -", "uni-north.", 1),
        (4, "glass gauge; quartz hinge; 75 g; ref k33", "uni_north", 1),
        (5, "gauge glass; quartz hinge; 7.5 g; ref k33", "uni_north", 1),
        (6, "glass gauge; quartz hinge; 7.5 g; ref k33", "uni_north", 0),
        (7, "glass gauge; quartz hinge; 7.5 g; ref k33", "uni_lake", 1),
        (8, "glass; gauge quartz hinge; 7.5 g; ref k33", "uni_north", 1),
    ]
    assert found(spark, rows) == [(1, 2), (1, 3)]


def test_nulls_blanks_ties_and_empty(spark):
    rows = [(1, "a; b", None, None), (2, "b; a", None, None), (2, "b; a", None, None), (3, "a; b", "", None), (4, None, "s", 1), (5, None, "s", 1), (6, " -- ", "s", 1), (7, "--", "s", 1), (8, "a, b " * 20_000, "s", 1), (9, "A,B " * 20_000, "s", 1)]
    assert found(spark, rows) == [(1, 2), (1, 2), (8, 9)]
    assert found(spark, []) == []
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    assert sorted((r.first_record_id, r.copies, r.label, r.source) for r in copies.collapse(df).collect()) == [(1, 3, None, None), (3, 1, None, ""), (8, 2, "1", "s")]


def test_a_digest_collision_is_confirmed_away(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, body string").selectExpr("id", "7L as root", "'' as label", "'' as source", "body")
    assert sorted((r.first_id, r.copies) for r in copies.groups(df).collect()) == [(1, 2), (2, 1)]


def test_hot_group_is_whole(spark):
    from tallyloom.operators.skew import salted_join

    rows = spark.range(500).selectExpr("id", "if(id < 400, 1, id) as k")
    groups = rows.groupBy("k").count()
    assert salted_join(rows, groups, ["k"], size="count", spread_by=["id"], hot=10).count() == 500
