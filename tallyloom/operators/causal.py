"""Matching, synthetic control, placebo draws and distribution tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ranks import running_counts

#: Controls are one row per market; above this number the match refuses rather than hold them in every task.
MAX_CONTROLS = 200_000


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariance of the complete rows, from one row of sums."""
    k = len(columns)
    rows = df.dropna(subset=columns)
    got = rows.agg(*[F.covar_samp(columns[i], columns[j]) for i in range(k) for j in range(i, k)]).first()
    c, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = got[at] or 0.0
            at += 1
    return c


def _nearest(t, x: np.ndarray, names: list, c: np.ndarray, inv: np.ndarray, ratio: int) -> list[tuple]:
    """(t, control, distance, rank) of the controls c nearest to x; see nearest_controls."""
    ok = np.isfinite(x)
    if not ok.any() or not names:
        return []
    d = c[:, ok] - x[ok]
    dist = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inv[np.ix_(ok, ok)], d), 0) * len(x) / ok.sum())
    return [(t, names[j], float(dist[j]), r + 1) for r, j in enumerate(np.argsort(np.round(dist, 12), kind="stable")[:ratio])]


def nearest_controls(units: DataFrame, key: str, treated: str, columns: list[str], *, ratio: int = 2) -> DataFrame:
    """(treated, control, distance, rank): the `ratio` nearest controls by Mahalanobis distance, with replacement.

    Covariates missing for a treated unit are left out of its distance (rescaled to all covariates); controls must be complete.
    Ties take the smaller key. The control matrix is one row per unit of checked number and goes to every task.
    """
    inv = np.linalg.pinv(covariance(units, columns))
    ctrl = units.filter(F.col(treated) == 0).dropna(subset=columns).select(key, *columns).orderBy(key).limit(MAX_CONTROLS + 1).toPandas()
    if len(ctrl) > MAX_CONTROLS:
        raise ValueError("too many controls")
    names, c = ctrl[key].tolist(), ctrl[columns].to_numpy(float)
    shared = units.sparkSession.sparkContext.broadcast((names, c, inv))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c, inv = shared.value
        for f in frames:
            out = []
            for t, x in zip(f[key], f[columns].to_numpy(float), strict=True):
                out += _nearest(t, x, names, c, inv, ratio)
            if out:
                yield pd.DataFrame(out, columns=["treated", "control", "distance", "rank"])

    kind = units.schema[key].dataType.simpleString()
    return units.filter(F.col(treated) == 1).select(key, *columns).mapInPandas(run, f"treated {kind}, control {kind}, distance double, rank int")


def placebo_matches(units: DataFrame, draws: DataFrame, key: str, columns: list[str], *, ratio: int = 2) -> DataFrame:
    """(draw, treated, control, distance, rank): nearest_controls of each draw, whose units are the treated and all others the controls.

    The covariance is that of all units, which every draw shares. units go to every task, one row per market of checked number;
    a draw that leaves no control has no rows.
    """
    inv = np.linalg.pinv(covariance(units, columns))
    rows = units.select(key, *columns).orderBy(key).limit(MAX_CONTROLS + 1).toPandas()
    if len(rows) > MAX_CONTROLS:
        raise ValueError("too many units")
    shared = units.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), rows[columns].to_numpy(float), inv))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, inv = shared.value
        drawn = np.isin(names, pdf[key].to_numpy())
        ok = ~drawn & np.isfinite(x).all(axis=1)
        out = [(int(pdf["draw"].iloc[0]), *row) for t, v in zip(names[drawn], x[drawn], strict=True) for row in _nearest(t, v, names[ok].tolist(), x[ok], inv, ratio)]
        return pd.DataFrame(out, columns=["draw", "treated", "control", "distance", "rank"])

    kind = units.schema[key].dataType.simpleString()
    return draws.groupBy("draw").applyInPandas(match, f"draw int, treated {kind}, control {kind}, distance double, rank int")


def matched_effects(pairs: DataFrame, changes: DataFrame, key: str, change: str) -> DataFrame:
    """(draw, n, b): the mean over the treated units of a draw of their change less the mean change of their controls.

    Units without a change don't count; n is the number of treated units that have one and a control with one.
    """
    of = lambda side: changes.select(F.col(key).alias(side), F.col(change).alias(f"__{side}"))
    each = pairs.join(of("treated"), "treated").join(of("control"), "control").groupBy("draw", "treated").agg((F.first("__treated") - F.avg("__control")).alias("b"))
    return each.groupBy("draw").agg(F.count("*").alias("n"), F.avg("b").alias("b"))


def optimal_pairs(cost: np.ndarray) -> list[int]:
    """The column assigned to each row at least total cost (rows <= columns); Hungarian algorithm with potentials."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            cur = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def match_all(distances: pd.DataFrame) -> list[tuple]:
    """(treated, control, distance): as many pairs as possible at least total distance, each unit once.

    distances: treated, control, distance of every pair. Where controls run short, who stays alone is part of the optimum: a
    treated unit may take a column of no control, at more than all distances together.
    """
    if distances.empty:
        return []
    wide = distances.pivot(index="treated", columns="control", values="distance")
    real = wide.to_numpy(float)
    alone = (real.max() + 1) * (len(wide) + 1)
    pick = optimal_pairs(np.hstack([real, np.full((len(wide), len(wide)), alone)]))
    return [(t, wide.columns[j], float(real[i, j])) for i, (t, j) in enumerate(zip(wide.index, pick, strict=True)) if j < real.shape[1]]


def simplex_weights(y: np.ndarray, x: np.ndarray, *, rounds: int = 4000) -> np.ndarray:
    """Weights w >= 0 that sum to 1 and bring x w closest to y: accelerated projected gradient."""
    k = x.shape[1]
    w = z = np.full(k, 1 / k)
    step, t = 1 / max(np.linalg.norm(x, 2) ** 2, 1e-12), 1.0
    for _ in range(rounds):
        g = z - step * (x.T @ (x @ z - y))
        s = np.sort(g)[::-1]
        c = np.cumsum(s) - 1
        r = np.nonzero(s - c / np.arange(1, k + 1) > 0)[0][-1]
        new = np.maximum(g - c[r] / (r + 1), 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w, t = new, t2
    return w


def synthetic_controls(stack: DataFrame, *, event: int, group: str = "experiment", unit: str = "unit", time: str = "time", value: str = "value", treated: str = "treated") -> DataFrame:
    """(group, unit, weight, rmspe): per group, donor weights that track the treated unit before the event.

    stack: each group's treated unit and its donors (all controls: a matrix of markets and years). Donors with a gap before the event are left out.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({group: pd.Series(dtype=pdf[group].dtype), unit: pd.Series(dtype=pdf[unit].dtype), "weight": pd.Series(dtype=float), "rmspe": pd.Series(dtype=float)})
        pre = pdf[pdf[time] < event]
        mine = pre[pre[treated] == 1].groupby(time)[value].mean()
        donors = pre[pre[treated] == 0].pivot_table(index=time, columns=unit, values=value).reindex(mine.index).dropna(axis=1)
        if mine.isna().any() or not len(mine) or donors.shape[1] == 0:
            return empty
        w = simplex_weights(mine.to_numpy(), donors.to_numpy())
        miss = float(np.sqrt(np.mean((donors.to_numpy() @ w - mine.to_numpy()) ** 2)))
        return pd.DataFrame({group: pdf[group].iloc[0], unit: list(donors.columns), "weight": w, "rmspe": miss})

    g, u = (stack.schema[c].dataType.simpleString() for c in (group, unit))
    return stack.groupBy(group).applyInPandas(fit, f"`{group}` {g}, `{unit}` {u}, weight double, rmspe double")


def placebo_draws(units: DataFrame, key: str, draws: int, size: int, seed: int = 1) -> DataFrame:
    """(draw, key): for each draw the `size` units of smallest hash of (key, draw, seed); the same on every run."""
    many = units.select(key).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = Window.partitionBy("draw").orderBy(F.xxhash64(F.col(key), F.col("draw"), F.lit(seed)), key)
    return many.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size).select("draw", key)


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """(mean0, mean1, t, dof) of the difference between groups 0 and 1 with unequal variances."""
    a = df.agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return a.select(F.col("m0").alias("mean0"), F.col("m1").alias("mean1"), ((F.col("m1") - F.col("m0")) / F.sqrt(s0 + s1)).alias("t"), ((s0 + s1) ** 2 / (s0**2 / (F.col("n0") - 1) + s1**2 / (F.col("n1") - 1))).alias("dof"))


def kolmogorov_smirnov(df: DataFrame, group: str, value: str) -> DataFrame:
    """(ks, n0, n1): the largest distance between the distributions of groups 0 and 1; any number of values."""
    ok = df.filter(F.col(group).isin(0, 1))
    run = running_counts(ok, [], value, {f"c{g}": F.sum((F.col(group) == g).cast("long")) for g in (0, 1)})
    total = run.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    both = run.crossJoin(F.broadcast(total))
    return both.agg(F.max(F.abs((F.col("c0") + F.col("before_c0")) / F.col("n0") - (F.col("c1") + F.col("before_c1")) / F.col("n1"))).alias("ks"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))


def prediction_metrics(df: DataFrame, truth: str, predictions: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., model, n, corr, mse, mae, slope, r2) from moment sums; rows without truth or prediction don't count."""
    out = []
    for p in predictions:
        ok = df.filter(F.col(truth).isNotNull() & F.col(p).isNotNull() & ~F.isnan(truth) & ~F.isnan(p))
        e = F.col(truth) - F.col(p)
        out.append(ok.groupBy(*by).agg(F.lit(p).alias("model"), F.count("*").alias("n"), F.corr(truth, p).alias("corr"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.regr_slope(truth, p).alias("slope"), (1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count("*"), F.lit(0.0))).alias("r2")))
    return reduce(DataFrame.unionByName, out)
