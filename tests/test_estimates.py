"""Estimates that must use all rows, controls or draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import causal
from tallyloom.plans import estimates as E
from tallyloom.plans import relational as R

SF = "/root/testdata/sf0.01"


def test_synthetic_control_gets_all_controls(spark):
    got = E.synthetic_control(spark, SF).toPandas()
    my = E.market_years(spark, SF).filter(F.col("yr") < E.EVENT).select("market", "yr", "lp").toPandas()
    wide = my.pivot_table(index="yr", columns="market", values="lp")
    controls = [r.category for r in R.cats(spark, SF).filter("treated = 0").collect() if r.category in wide]
    for t, g in got.groupby("experiment"):
        mine = wide[t].dropna()
        assert set(g.unit) == set(wide[controls].reindex(mine.index).dropna(axis=1).columns)
        assert g.weight.sum() == pytest.approx(1) and (g.weight >= 0).all()
    assert len(got) and got.groupby("experiment").size().max() > 10


def test_optimal_match_sees_every_control(spark, monkeypatch):
    from itertools import permutations

    import pandas as pd

    # 40 treated markets beside 31 controls and one far away: all 32 controls are used, at real distances
    rows = [(f"t{i:02d}", 1, i * 0.001, 0.1 * (i % 3)) for i in range(40)] + [(f"c{i:02d}", 0, i * 0.01, 0.1) for i in range(31)] + [("far", 0, 50.0, 9.0)]
    monkeypatch.setattr(E, "_units", lambda s, d: s.createDataFrame(rows, "market string, treated int, x1 double, x2 double"))
    got = E.optimal_match(spark, SF).collect()
    assert {r.control for r in got} == {r[0] for r in rows if not r[1]} and len({r.treated for r in got}) == 32
    assert max(r.distance for r in got) < 1e3
    # against all assignments, controls short and controls plenty
    rng = np.random.default_rng(5)
    for n, m in ((5, 3), (3, 5)):
        c = rng.random((n, m))
        pairs = causal.match_all(pd.DataFrame([(f"t{i}", f"c{j}", c[i, j]) for i in range(n) for j in range(m)], columns=["treated", "control", "distance"]))
        if n > m:
            best = min(sum(c[i, j] for j, i in enumerate(p)) for p in permutations(range(n), m))
        else:
            best = min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))
        assert len(pairs) == min(n, m) and sum(x[2] for x in pairs) == pytest.approx(best)


def test_ridge_uses_all_rows(spark):
    from tallyloom.operators import regress

    cols = ["pred_knn", "pred_ridge", "max_sim_to_train"]
    rows = R.table(spark, SF, "ridge_vs_knn").filter("true_exposure between 0 and 1 and not isnan(true_exposure)").select("true_exposure", *cols).dropna().toPandas()
    x, y = rows[cols].to_numpy(float), rows["true_exposure"].to_numpy(float)
    x, y = x - x.mean(0), y - y.mean()
    got = E.ridge_by_neighbours(spark, SF).toPandas().set_index("term").loc[cols]
    alpha = got["alpha"].iloc[0]
    assert np.allclose(got["b"], np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y), atol=1e-9)
    # the primal form picks what the dual form picks
    few, fy = x[:300] - x[:300].mean(0), y[:300] - y[:300].mean()
    b, a = regress.ridge_gcv(few, fy)
    b2, a2 = regress.ridge_gcv_moments(few.T @ few, few.T @ fy, fy @ fy, 300)
    assert a2 == a and np.allclose(b, b2, atol=1e-8)


def test_crosswalk_scores_every_shared_word(spark):
    from tallyloom.operators import entities

    right = ["gamma"] + [f"gamma delta{i}" for i in range(5)] + ["alpha x", "beta y"]
    got = entities.crosswalk(spark.createDataFrame([("alpha beta gamma",), ("zeta",)], "l string"), spark.createDataFrame([(r,) for r in right], "r string"), "l", "r").collect()
    assert [(r.l, r.r, r.score, r["rank"]) for r in got] == [("alpha beta gamma", "gamma", 100.0, 1)]


def test_placebo_rematches_each_draw(spark):
    rng = np.random.default_rng(8)
    rows = [(f"m{i:02d}", float(rng.normal()), float(rng.normal())) for i in range(70)]
    effect = {k: x + 0.01 * i for i, (k, x, _) in enumerate(rows)}
    units = spark.createDataFrame(rows, "market string, x1 double, x2 double")
    pairs = causal.placebo_matches(units, causal.placebo_draws(units, "market", 5, 46), "market", ["x1", "x2"]).toPandas()
    assert set(pairs["draw"]) == {1, 2, 3, 4, 5}
    at, inv = {k: np.array(v) for k, *v in rows}, np.linalg.inv(np.cov(np.array([r[1:] for r in rows]).T))
    for _, g in pairs.groupby("draw"):
        drawn = set(g["treated"])
        assert len(drawn) == 46 and not drawn & set(g["control"])
        for t, m in g.groupby("treated"):
            dist = sorted((float(np.sqrt((at[t] - at[c]) @ inv @ (at[t] - at[c]))), c) for c in at if c not in drawn)
            assert list(m.sort_values("rank")["control"]) == [c for _, c in dist[:2]]
    b = spark.createDataFrame(list(effect.items()), "market string, b double")
    got = causal.matched_effects(spark.createDataFrame(pairs), b, "market", "b").toPandas().set_index("draw")
    for k, g in pairs.groupby("draw"):
        want = np.mean([effect[t] - np.mean([effect[c] for c in m["control"]]) for t, m in g.groupby("treated")])
        assert got.loc[k, "b"] == pytest.approx(want) and got.loc[k, "n"] == 46


def test_models_run_with_the_surveyed_settings(spark, monkeypatch):
    import inspect

    from tallyloom.operators import models
    from tallyloom.plans import texts

    class Seen(Exception):
        pass

    def seen(name):
        sig = inspect.signature(getattr(models, name))

        def f(*a, **k):
            x = sig.bind(*a, **k)
            x.apply_defaults()
            raise Seen(x.arguments)

        return f

    got = {}
    for query, name in (("gatekeeper_scores", "gatekeeper"), ("forest_importance", "forest"), ("elastic_net_coefficients", "elastic_net")):
        monkeypatch.setattr(models, name, seen(name))
        with pytest.raises(Seen) as e:
            texts.QUERIES[query](spark, SF)
        got[query] = e.value.args[0]
    assert got["gatekeeper_scores"]["features"] == {"ngrams": 3, "min_df": 5} and got["gatekeeper_scores"]["c"] == 10
    assert got["forest_importance"]["folds"] == 5 and got["forest_importance"]["trees"] == 40
    assert got["elastic_net_coefficients"]["folds"] == 5
