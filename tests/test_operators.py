import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import semantics as S
from tallyloom.functions import text as X
from tallyloom.operators import causal, entities, merges, panel, regress, rules, similarity
from tallyloom.operators.graph import greedy_stars


def test_missing_value_algebra(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, x double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(S.drop_if(df, S.le(F.col("x"), 0))) == [1, 2]
    assert ids(S.drop_if(df, S.gt(F.col("x"), 3))) == [3]
    assert df.filter("id = 2").agg(S.sum0(F.col("x")).alias("s")).first().s == 0


def brute_pctile(v, p):
    v, n = sorted(v), len(v)
    k = n * p
    return (v[round(k) - 1] + v[round(k)]) / 2 if abs(k - round(k)) < 1e-9 and 0 < round(k) < n else v[math.ceil(k - 1e-9) - 1]


def test_percentiles_against_brute_force(spark):
    random.seed(1)
    for n in (1, 2, 4, 10, 33, 100):
        v = [random.randint(0, 20) for _ in range(n)]
        df = spark.createDataFrame([(float(x),) for x in v], "x double")
        for p in (0.01, 0.25, 0.5, 0.75, 0.99):
            assert df.agg(S.pctile_avg("x", p).alias("q")).first().q == brute_pctile(v, p), (v, p)


def test_dates_money_quarters(spark):
    df = spark.createDataFrame([("03/02/2014", "$1,200.50"), ("2014-02-03", "x"), ("bad", None)], "d string, m string")
    got = df.select(S.try_date(F.col("d")).alias("d"), S.money(F.col("m")).alias("m"), S.quarter_index(S.try_date(F.col("d"))).alias("q")).collect()
    assert [str(r.d) for r in got] == ["2014-02-03", "2014-02-03", "None"] and [r.m for r in got] == [1200.5, None, None] and got[0].q == 2014 * 4


def test_merge_codes_and_contracts(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, y string")
    codes = lambda d: sorted((r.k is None, r.k or 0, r.merge_code) for r in d.collect())
    assert codes(merges.merge(a, b, ["k"])) == [(False, 1, 3), (False, 3, 1), (False, 4, 2), (True, 0, 3)]
    assert codes(merges.merge(a, b, ["k"], keep=(1,))) == [(False, 3, 1)]
    assert merges.merge(a, b, ["k"], null_safe=False, keep=(3,)).count() == 1
    with pytest.raises(ValueError):
        merges.merge(a, b, ["k"], expect=(1, 3))
    with pytest.raises(ValueError):
        merges.require_unique(a.union(a), ["k"])


def test_update_merge_never_overwrites(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "z"), (2, "y"), (3, "c")], "k int, x string")
    got = {r.k: (r.x, r.merge_code) for r in merges.update_merge(a, b, ["k"], ["x"]).collect()}
    assert got == {1: ("a", 5), 2: ("y", 4), 3: ("c", 3), 4: ("d", 1)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(2000, 2009), st.one_of(st.none(), st.integers(0, 5))), max_size=20, unique_by=lambda t: t[:2]))
def test_fill_and_carry_against_loops(spark, rows):
    df = spark.createDataFrame(rows, "u int, t int, x int")
    got = {(r.u, r.t): (r.x, r.f) for r in panel.fill_span(df, ["u"], "t").withColumn("f", panel.carry_forward("x", ["u"], "t")).collect()}
    want, by = {}, {}
    for u, t, x in rows:
        by.setdefault(u, {})[t] = x
    for u, m in by.items():
        last = None
        for t in range(min(m), max(m) + 1):
            last = m.get(t) if m.get(t) is not None else last
            want[u, t] = (m.get(t), last)
    assert got == want


def test_sandwich_and_step_change(spark):
    for given_, want in (("abacab", "aaaaab"), ("abab", "aaab"), ("abba", "abba")):
        df = spark.createDataFrame([(1, t, v) for t, v in enumerate(given_)], "u int, t int, v string")
        assert [r.v for r in panel.sandwich(df, ["u"], "t", "v").orderBy("t").collect()] == list(want)
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 4, 9)], "u int, t int, x int")
    assert [r.s for r in df.withColumn("s", panel.step_change("x", ["u"], "t")).orderBy("t").collect()] == [None, 2, None]


def test_settled_values(spark):
    rows = [("a", t, "x", 1) for t in (1, 2, 3, 5)] + [("a", 3, "y", 9), ("a", 20, "p", 1), ("a", 20, "q", 2), ("b", 1, "z", 1)]
    got = {(r.u, r.t): r.v for r in panel.settle_values(spark.createDataFrame(rows, "u string, t int, v string, w int"), "u", "t", "v", "w").collect()}
    assert got[("a", 3)] == "x" and got[("a", 20)] == "q" and got[("b", 1)] == "z" and len(got) == 6


def test_shares_and_exposure_sum(spark):
    s = spark.createDataFrame([("u", "m1", 30.0), ("u", "m2", 70.0), ("v", "m1", 5.0), ("w", "m1", 0.0)], "u string, m string, a double")
    e = spark.createDataFrame([("m1", 2.0)], "m string, b double")
    got = {r.u: (r.exposure, r.share_sum) for r in panel.shift_share(s, "u", "m", "a", e, "b").collect()}
    assert got == {"u": (pytest.approx(0.6), pytest.approx(0.3)), "v": (2.0, 1.0)}


def make_panel(spark, seed=0, n=12, t=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for k in range(t):
            if rng.random() < 0.9:
                x = rng.normal() + 0.3 * i
                rows.append((i, k, float(x), float(0.7 * x + i * 0.5 - k * 0.2 + rng.normal()), float(rng.integers(1, 5)), float(rng.poisson(np.exp(0.2 * x + 0.05 * i - 0.1 * k)))))
    return rows, spark.createDataFrame(rows, "i int, t int, x double, y double, w double, c double")


def dummies(rows):
    i, t = [r[0] for r in rows], [r[1] for r in rows]
    return np.array([[float(a == v) for v in sorted(set(i))] + [float(b == v) for v in sorted(set(t))[1:]] for a, b in zip(i, t, strict=True)])


def test_fe_ols_equals_dummies(spark):
    rows, df = make_panel(spark)
    a = np.array([r[2:5] for r in rows])
    x, y, w = a[:, 0], a[:, 1], a[:, 2]
    z = np.column_stack([x, dummies(rows)])
    sw = np.sqrt(w)[:, None]
    beta, *_ = np.linalg.lstsq(z * sw, y * sw[:, 0], rcond=None)
    fit = regress.fe_ols(df, "y", ["x"], absorb=["i", "t"], clusters=["i"], weight="w")
    assert fit.b[0] == pytest.approx(beta[0], abs=1e-6)
    e = y - z @ beta
    d = dummies(rows)
    xt = x - d @ np.linalg.lstsq(d * sw, x * sw[:, 0], rcond=None)[0]
    g = sorted({r[0] for r in rows})
    meat = sum((w * xt * e)[[r[0] == c for r in rows]].sum() ** 2 for c in g)
    n, years = len(rows), len({r[1] for r in rows})
    # the factor i is nested in the cluster; the constant and the years but one are taken
    se = math.sqrt(meat) / (w * xt * xt).sum() * math.sqrt(len(g) / (len(g) - 1) * (n - 1) / (n - 1 - years))
    assert fit.se[0] == pytest.approx(se, rel=1e-5) and fit.n == len(rows)
    plain = regress.fe_ols(df, "y", ["x"], absorb=["i", "t"], weight="w")
    classical = math.sqrt((w * e * e).sum() / (n - z.shape[1]) / (w * xt * xt).sum())
    assert plain.se[0] == pytest.approx(classical, rel=1e-5)


def test_absorbed_levels(spark):
    # two islands of i and t; u is a coarser i
    df = spark.createDataFrame([(i, t, i // 2, 1.0 * i) for i in range(6) for t in range(4) if (i < 4) == (t < 2)], "i int, t int, u int, x double")
    assert regress.absorbed_levels(df, ["i"]) == 6 and regress.absorbed_levels(df, []) == 0
    assert regress.absorbed_levels(df, ["i", "t"]) == 6 + 4 - 2
    assert regress.absorbed_levels(df, ["i", "u"]) == 6
    assert regress.absorbed_levels(df, ["i", "t"], ["i"]) == 4 - 2 + 1
    assert regress.absorbed_levels(df, ["i", "t"], ["u"]) == 4 - 2 + 1


def test_poisson_score_is_zero(spark):
    rows, df = make_panel(spark, 3)
    fit = regress.fe_poisson(df, "c", ["x"], absorb=["i", "t"], clusters=["i"])
    y, x = np.array([r[5] for r in rows]), np.array([r[2] for r in rows])
    z = np.column_stack([x, dummies(rows)])
    b = np.zeros(z.shape[1])
    b[1:] = math.log(y.mean()) / 2
    for _ in range(60):
        mu = np.exp(np.clip(z @ b, -30, 30))
        b += np.linalg.lstsq((z.T * mu) @ z, z.T @ (y - mu), rcond=None)[0]
    assert fit.b[0] == pytest.approx(b[0], abs=1e-5)


def test_singletons_and_separation_are_dropped(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 0.0, 3.0), (2, 2, 1.0, 5.0), (3, 1, 0.5, 2.0)], "i int, t int, x double, y double")
    assert regress.fe_poisson(df, "y", ["x"], absorb=["i"]).n == 3
    assert regress.fe_ols(df, "y", ["x"], absorb=["i"], singletons=True).n == 4


def test_ridge_picks_a_strength():
    rng = np.random.default_rng(1)
    x, b = rng.normal(size=(60, 5)), np.array([1.0, -2.0, 0.0, 0.5, 0.0])
    got, alpha = regress.ridge_gcv(x - x.mean(0), (x @ b + 0.1 * rng.normal(size=60)) - (x @ b).mean())
    assert np.abs(got - b).max() < 0.1 and alpha < 10


def test_matching_and_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{i:02d}", int(i < 4), float(rng.normal()), float(rng.normal())) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, d int, x double, y double")
    got = causal.nearest_controls(df, "k", "d", ["x", "y"]).collect()
    a = np.array([r[2:] for r in rows])
    inv = np.linalg.inv(np.cov(a.T))
    for i in range(4):
        dist = sorted((math.sqrt((a[i] - a[j]) @ inv @ (a[i] - a[j])), rows[j][0]) for j in range(4, 20))[:2]
        assert [(r.control, r.rank) for r in got if r.treated == rows[i][0]] == [(dist[0][1], 1), (dist[1][1], 2)]
    w = causal.simplex_weights(np.array([1.0, 2.0, 3.0]), np.array([[0.0, 2.0], [1.0, 3.0], [2.0, 4.0]]))
    assert w == pytest.approx([0.5, 0.5], abs=1e-4)


def test_optimal_pairs_against_permutations():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.integers(0, 30, (4, 6)).astype(float)
        got = causal.optimal_pairs(c)
        assert len(set(got)) == 4
        assert sum(c[i, j] for i, j in enumerate(got)) == min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(6), 4))


def test_porter_known_stems():
    # published examples of the algorithm
    for w, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "homologou": "homolog", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener"}.items():
        assert X.porter(w) == want, w


def test_text_helpers(spark):
    assert X.fold("Ångström Øre β-Straße") == "angstrom ore beta-strasse" and X.fold(None) is None
    df = spark.createDataFrame([("5R01GM012345-07",), ("gm 1234",), (None,)], "g string")
    got = [tuple(r.p) for r in df.select(X.grant_parts(F.col("g")).alias("p")).collect()]
    assert got == [("R01", "GM", "012345"), (None, "GM", "001234"), (None, None, None)]
    with pytest.raises(KeyError):
        X.clean(F.lit("x"), ["nothing"])
    p = X.keyword_pattern(["pipette tip", "*mouse*"])
    import re

    assert all(re.search(p, s) for s in ("Pipette-Tips", "pipettetip", "anti mouse igg", "dormouses")) and not re.search(p, "pipette tipping")


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_common_length(a, b):
    assert entities.common_length(a, b) == lcs(a, b)


def test_stars_equal_the_sequential_pass(spark):
    random.seed(5)
    n = 60
    edges = sorted({tuple(sorted(random.sample(range(n), 2))) for _ in range(90)})
    order = {i: (random.randint(0, 5), i) for i in range(n)}
    want, near = {}, {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(order, key=order.get):
        if i not in want:
            want[i] = i
            for j in near[i]:
                want.setdefault(j, i)
    nodes = spark.createDataFrame([(i, order[i][0]) for i in range(n)], "node int, o int")
    got = {r.node: r.parent for r in greedy_stars(nodes, spark.createDataFrame(edges, "a int, b int"), ["o", "node"]).collect()}
    assert got == want


def test_suppliers_match_the_map(spark):
    d = "/root/testdata/sf0.01"
    m = spark.read.parquet(f"{d}/supplier_map.parquet")
    got = entities.resolve_suppliers(m, "suppliername").join(m, "suppliername")
    assert got.groupBy("new_suppliername").agg(F.countDistinct("parent").alias("n")).filter("n > 1").count() == 0
    assert got.select("parent").distinct().count() == m.select("new_suppliername").distinct().count()


def test_people_in_three_passes(spark):
    pis = spark.createDataFrame([(1, "Ardent", "Mira K", "O1"), (2, "Bolden", "Teo", "O2"), (3, "Carrow", "Lin", "O3"), (4, "Dorn", "Vik", "O9")] + [(10 + i, f"Uniq{i}", "Sam", "O5") for i in range(3)] + [(20, "Twin", "Jo", "O5")], "pi_id int, surname string, given string, org string")
    authors = spark.createDataFrame([("A1", "Ardent", "M", "I1"), ("A2", "Ardent", "Max", "I7"), ("A3", "Bolden", "Teo", "I8"), ("A4", "Carrow", "Lin", "I8"), ("A5", "Carrow", "Lin", "I9")] + [(f"U{i}", f"Uniq{i}", "Sam", "I5") for i in range(3)] + [("T1", "Twin", "Jo", "I5"), ("T2", "Twin", "Jo", "I6")], "athr_id string, surname string, given string, inst string")
    edges = spark.createDataFrame([("O1", "I1")], "org string, inst string")
    got = {r.pi_id: (r.athr_id, r["pass"]) for r in entities.match_people(pis, authors, edges).collect()}
    assert got == {1: ("A1", 1), 2: ("A3", 2), 10: ("U0", 2), 11: ("U1", 2), 12: ("U2", 2), 20: ("T1", 3)}


def test_rules_batch_equals_single_rows(spark):
    rs = rules.RuleSet.from_dict({"keyword_groups": {"G": ["gel box", "tray"]}, "market_rules": [{"name": "a - x", "any_of": ["$G"], "none_of": ["steel"]}, {"name": "b", "all_of": ["steel", "tray"]}, {"name": "c", "regex_any_of": [r"Eco[RI]+"], "case_sensitive": True}, {"name": "a - y", "exact_any_of": ["lone"]}, {"name": "d", "any_of": ["*mouse*"], "regex_none_of": ["pad$"]}], "required_keywords": {"a": {"none_of": ["forbidden"]}}})
    texts = ["gel-boxes", "steel tray", "EcoRI", "ecori", "lone", "lone wolf", "dormouse", "mouse pad", "tray forbidden", "", None]
    df = spark.createDataFrame([(i, t.lower() if t else t, t) for i, t in enumerate(texts)], "id int, clean string, raw string")
    got = {r.id: r.rule for r in rules.classify(df, rs, "id", "clean", "raw").collect()}
    assert [got[i] for i in range(len(texts))] == ["a - x", "b", "c", None, "a - y", None, "d", None, None, None, None]
    with pytest.raises(KeyError):
        rules.Engine(rules.RuleSet((rules.Rule("z", any_of=("$NONE",)),)))


def test_knn_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    one = sorted(map(tuple, similarity.knn(df, df.filter("id < 15"), "id", "v").collect()))
    monkeypatch.setattr(similarity, "ANCHOR_BYTES", 8 * 5 * 4)
    many = sorted(map(tuple, similarity.knn(df, df.filter("id < 15"), "id", "v").collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many]
    by = {}
    for i, _, _, w in one:
        by[i] = by.get(i, 0) + w
    assert all(s == pytest.approx(1) for s in by.values())


def test_tfidf_unit_length(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, None), (4, "")], "id int, t string")
    c = similarity.term_counts(df, "id", "t", ngrams=2)
    assert {(r.id, r.term, r.tf) for r in c.collect()} == {(1, "a", 1), (1, "b", 2), (1, "c", 1), (1, "a b", 1), (1, "b b", 1), (1, "b c", 1), (2, "b", 1), (2, "c", 1), (2, "b c", 1)}
    for r in similarity.tfidf(c, "id").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_readers(spark, tmp_path):
    from tallyloom.sources import readers

    (tmp_path / "a.csv").write_text('Item Name,Price,Date\n"x, ""y""\nz","$1,000.00",03/02/2014\n,,\n')
    df = readers.standardize(readers.read_any(spark, str(tmp_path / "a.csv")), {"product_desc": "item_name", "price": "price", "date": "date"})
    got = df.collect()
    assert (got[0].product_desc, got[0].price, str(got[0].date), got[0].sku) == ('x, "y"\nz', 1000.0, "2014-02-03", None) and len(df.columns) == 13
    (tmp_path / "b.txt").write_text('id,the abstract\nid1,"some, text"\nid4,12345\n@skip,x\n\nid2,null\nid3,abc\n')
    assert [tuple(r) for r in readers.two_fields(spark, str(tmp_path / "b.txt"), ("id", "t")).collect()] == [("id1", "some, text")]
    (tmp_path / "y/2011").mkdir(parents=True)
    (tmp_path / "y/2011/a.json").write_text('{"id": 1, "pi": [{"name": "n1"}, {"name": "n2"}]}')
    j = readers.json_documents(spark, str(tmp_path / "y"))
    assert j.first().folder_year == 2011
    assert [tuple(r) for r in readers.nested_table(j, "id", "pi", {"name": "name"}).collect()] == [(1, 0, "n1"), (1, 1, "n2")]
    (tmp_path / "c.xml").write_text("<r><g><id>1</id><a>x</a></g><g><id>2</id></g></r>")
    assert sorted((r.id, r.a) for r in readers.xml_rows(spark, str(tmp_path / "c.xml"), "g").collect()) == [(1, "x"), (2, None)]
    import pandas as pd

    pd.DataFrame({"k": [1, 2, 3], "s": ["a", "b", ""]}).to_stata(tmp_path / "d.dta", write_index=False)
    assert readers.stata(spark, str(tmp_path / "d.dta"), str(tmp_path / "d"), chunk=2).count() == 3
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.unknown")


def test_stream_panel(spark, tmp_path):
    from tallyloom.streaming import panels

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    q = panels.start(panels.period_panel(panels.arriving(spark, str(tmp_path / "in")), ["event_type"], "ts", "value"), str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    j = got.withColumn("d", F.to_date("period_start")).join(want.withColumnRenamed("n", "m"), ["event_type", "d"])
    assert j.count() == got.count() > 0 and j.filter("n <> m").count() == 0


def test_char_runs_and_blocks(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "id int, t string")
    got = {(r.id, r.term): r.tf for r in similarity.char_counts(df, "id", "t", low=3, high=4).collect()}
    assert got == {(1, " ab"): 1, (1, "ab "): 1, (1, " ab "): 1, (1, " c "): 1}
    w = spark.createDataFrame([(1, "x", 1.0)], "id int, term string, weight double")
    assert sorted(map(tuple, similarity.concat_blocks([("a", w, 0.85), ("b", w, 0.15)], "id").collect())) == [(1, "a:x", 0.85), (1, "b:x", 0.15)]
