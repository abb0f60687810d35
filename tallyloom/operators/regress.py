"""Linear and Poisson regressions with absorbed factors and clustered errors.

One pass reduces the rows to cells, one for each combination of absorbed factors and clusters, with the sums and cross
products of the variables. Everything iterative then runs on the cells; only moment matrices of the size of the number of
regressors reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graph import connected_components
from tallyloom.runtime import materialize


@dataclass
class Fit:
    """Coefficients of one regression."""

    terms: list[str]
    b: np.ndarray
    v: np.ndarray
    n: int
    clusters: dict[str, int] = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        d = np.diag(self.v)
        return np.where(np.isnan(self.b), np.nan, np.sqrt(np.maximum(np.nan_to_num(d), 0)))

    def rows(self) -> list[tuple]:
        """(term, b, se, lb, ub, n); a regressor that doesn't vary has nulls."""
        say = lambda x: float(x) if np.isfinite(x) else None
        return [(t, say(b), say(s), say(b - 1.96 * s), say(b + 1.96 * s), self.n) for t, b, s in zip(self.terms, self.b, self.se, strict=True)]

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "term string, b double, se double, lb double, ub double, n long")


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inv = np.linalg.pinv(xx)
    b, dead = inv @ xy, np.diag(xx) <= 1e-12
    b[dead] = np.nan
    inv[dead, :] = inv[:, dead] = np.nan if dead.all() else 0.0
    return b, inv


def drop_singletons(cells: DataFrame, factors: list[str], *, max_rounds: int = 20) -> DataFrame:
    """Drops, again and again, the factor levels that have a single observation (column n)."""
    for _ in range(max_rounds):
        lone = reduce(DataFrame.unionByName, [cells.groupBy(f).agg(F.sum("n").alias("__m")).filter("__m = 1").agg(F.count("*").alias("c")) for f in factors])
        if not lone.agg(F.sum("c")).first()[0]:
            return cells
        for f in factors:
            cells = cells.join(cells.groupBy(f).agg(F.sum("n").alias("__m")).filter("__m > 1").select(f), f, "left_semi")
        cells = materialize(cells, "cells")
    return cells


def demean(cells: DataFrame, columns: list[str], factors: list[str], weight: str = "w", *, tol: float = 1e-9, max_sweeps: int = 200) -> DataFrame:
    """Weighted alternating projections: the columns minus their means by each factor in turn, until nothing moves.

    Level means are an aggregate joined back, so a level with a third of the cells isn't one task's work. A single factor
    needs one sweep. The stop rule is the largest change of a sweep against the largest value of its column.
    (It is read from the written sweep: an Observation would leave the session unable to serialise MLlib's closures.)
    """
    if not factors:
        m = cells.agg(*[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"__m_{c}") for c in columns])
        return cells.crossJoin(F.broadcast(m)).withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])
    scale = cells.agg(*[F.max(F.abs(c)) for c in columns]).first()
    for _ in range(max_sweeps):
        new = cells.withColumns({f"__o_{c}": F.col(c) for c in columns})
        for f in factors:
            m = new.groupBy(f).agg(*[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"__m_{c}") for c in columns])
            new = new.join(m, f).withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])
        new = materialize(new, "cells")
        steps = new.agg(*[F.max(F.abs(F.col(c) - F.col(f"__o_{c}"))) for c in columns]).first()
        cells = new.drop(*[f"__o_{c}" for c in columns])
        moved = max((m or 0.0) / (s or 1.0) for m, s in zip(steps, scale, strict=True))
        if len(factors) == 1 or moved < tol:
            return cells
    raise RuntimeError(f"demeaning did not settle in {max_sweeps} sweeps")


def _meat(scores: DataFrame, cols: list[str], by: list[str]) -> tuple[np.ndarray, int]:
    per = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    k = len(cols)
    got = per.agg(F.count("*"), *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in _pairs(k)]).first()
    m = np.zeros((k, k))
    for (i, j), x in zip(_pairs(k), got[1:], strict=True):
        m[i, j] = m[j, i] = x or 0.0
    return m, got[0]


def absorbed_levels(cells: DataFrame, absorb: list[str], clusters: list[str] = ()) -> int:
    """Degrees of freedom that the absorbed factors take: their levels less the redundant ones.

    The first factor counts all its levels; of another, as many are redundant as it and an earlier factor have connected
    components (the most of any earlier one). Factors nested in a cluster, each level in one cluster, take none; if there are
    any, one is taken for the constant.
    """
    if not absorb:
        return 0
    nested = {f for f in absorb for c in clusters if f == c or cells.groupBy(f).agg((F.min(c) != F.max(c)).alias("x")).filter("x").isEmpty()}
    open_ = [f for f in absorb if f not in nested]
    levels = cells.agg(*[F.count_distinct(f).alias(f) for f in absorb]).first()
    return sum(levels[f] - max((_components(cells, levels, g, f) for g in absorb[: absorb.index(f)]), default=0) for f in open_) + bool(nested)


def _components(cells: DataFrame, levels, f: str, g: str) -> int:
    """Connected components of two factors that meet in cells."""
    met = cells.select(F.col(f).alias("f"), F.col(g).alias("g")).distinct()
    # a level that meets all of the other factor connects everything
    for one, other in (("g", f), ("f", g)):
        if (met.groupBy(one).count().agg(F.max("count")).first()[0] or 0) == levels[other]:
            return 1
    name = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    return connected_components(met.select(name("f").alias("a"), name("g").alias("b"))).select("component").distinct().count()


def _sandwich(scores: DataFrame, cols: list[str], inv: np.ndarray, clusters: list[str], n: int, absorbed: int = 0) -> tuple[np.ndarray, dict[str, int]]:
    """Variance clustered by one column, or by two as V1 + V2 - V12; each part scaled by G/(G-1) (n-1)/(n-k-absorbed)."""
    k, counts, v = len(cols), {}, np.zeros((len(cols), len(cols)))
    parts = [([clusters[0]], 1)] if len(clusters) == 1 else [([clusters[0]], 1), ([clusters[1]], 1), (list(clusters[:2]), -1)]
    for by, sign in parts:
        m, g = _meat(scores, cols, by)
        counts["#".join(by)] = g
        v += sign * inv @ m @ inv * (g / max(1, g - 1)) * ((n - 1) / max(1, n - k - absorbed))
    return v, counts


def fe_ols(df: DataFrame, y: str, xs: list[str], *, absorb: list[str] = (), clusters: list[str] = (), weight: str | None = None, singletons: bool = False, tol: float = 1e-9) -> Fit:
    """Weighted least squares of y on xs with the factors absorbed.

    Rows with a missing variable, factor, cluster or weight, or a weight that isn't positive, are left out. Without clusters
    the errors are classical. Both kinds subtract the levels of the absorbed factors (absorbed_levels). Collinear regressors share a minimum-norm solution. An interacted factor is a column of its own.
    """
    vs, w = [y, *xs], F.col(weight) if weight else F.lit(1.0)
    keys = list(dict.fromkeys([*absorb, *clusters]))
    rows = df.dropna(subset=[*dict.fromkeys([*vs, *keys, *([weight] if weight else [])])])
    if weight:
        rows = rows.filter(F.col(weight) > 0)
    k = len(vs)
    sums = [F.count("*").alias("n"), F.sum(w).alias("w")] + [F.sum(w * F.col(v)).alias(f"s{i}") for i, v in enumerate(vs)] + [F.sum(w * F.col(vs[i]) * F.col(vs[j])).alias(f"m{i}_{j}") for i, j in _pairs(k)]
    cells = materialize(rows.groupBy(*keys).agg(*sums).withColumns({f"a{i}": F.col(f"s{i}") / F.col("w") for i in range(k)}), "cells")
    if singletons and absorb:
        cells = drop_singletons(cells, list(absorb))
    cells = demean(cells, [f"a{i}" for i in range(k)], list(absorb), tol=tol)
    fit = [F.col(f"s{i}") / F.col("w") - F.col(f"a{i}") for i in range(k)]
    cross = {(i, j): F.col(f"m{i}_{j}") - fit[i] * F.col(f"s{j}") - fit[j] * F.col(f"s{i}") + F.col("w") * fit[i] * fit[j] for i, j in _pairs(k)}
    got = cells.agg(F.sum("n"), *[F.sum(cross[p]) for p in _pairs(k)]).first()
    n, full = int(got[0] or 0), np.zeros((k, k))
    for (i, j), x in zip(_pairs(k), got[1:], strict=True):
        full[i, j] = full[j, i] = x or 0.0
    b, inv = _solve(full[1:, 1:], full[1:, 0])
    taken = absorbed_levels(cells, list(absorb), list(clusters))
    if not clusters:
        s2 = (full[0, 0] - np.nan_to_num(b) @ full[1:, 0]) / max(1, n - k + 1 - (taken if absorb else 1))
        return Fit(list(xs), b, inv * s2, n)
    at = lambda i, j: cross[min(i, j), max(i, j)]
    score = [at(j, 0) - sum((at(j, i) * float(np.nan_to_num(b[i - 1])) for i in range(1, k)), F.lit(0.0)) for j in range(1, k)]
    cols = [f"u{j}" for j in range(1, k)]
    v, counts = _sandwich(cells.select(*clusters, *[c.alias(u) for c, u in zip(score, cols, strict=True)]), cols, inv, list(clusters), n, taken)
    return Fit(list(xs), b, v, n, counts)


def fe_poisson(df: DataFrame, y: str, xs: list[str], *, absorb: list[str] = (), clusters: list[str] = (), tol: float = 1e-8, max_rounds: int = 60) -> Fit:
    """Poisson pseudo-likelihood of y >= 0 on xs with the factors absorbed, by reweighted least squares.

    Rows alike in regressors, factors and clusters are one cell with their count as exposure, which leaves the estimate
    unchanged. Levels of a factor whose y is 0 throughout say nothing and are dropped (again and again).
    """
    keys = list(dict.fromkeys([*absorb, *clusters]))
    rows = df.dropna(subset=[*dict.fromkeys([y, *xs, *keys])]).filter(F.col(y) >= 0)
    x = [f"x{i}" for i in range(len(xs))]
    cells = rows.groupBy(*keys, *[F.col(c).cast("double").alias(a) for c, a in zip(xs, x, strict=True)]).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count("*").alias("n"))
    cells = materialize(cells, "cells")
    for _ in range(20 if absorb else 0):
        before = cells.count()
        for f in absorb:
            cells = cells.join(cells.groupBy(f).agg(F.sum("y").alias("__t")).filter("__t > 0").select(f), f, "left_semi")
        cells = materialize(cells, "cells")
        if cells.count() == before:
            break
    n = int(cells.agg(F.sum("n")).first()[0] or 0)
    mean = cells.agg(F.sum("y") / F.sum("n")).first()[0] or 1.0
    cells = cells.withColumn("mu", (F.col("y") + F.col("n") * F.lit(mean)) / 2).withColumn("eta", F.ln(F.col("mu") / F.col("n")))
    old, gap, b, inv = None, 1e-3, np.zeros(len(xs)), np.eye(len(xs))
    for _ in range(max_rounds):
        work = cells.withColumns({"w": F.col("mu"), "z": F.col("eta") + (F.col("y") - F.col("mu")) / F.col("mu"), **{f"d{c}": F.col(c) for c in x}}).withColumn("dz", F.col("z"))
        d = demean(work, ["dz", *[f"d{c}" for c in x]], list(absorb), tol=gap)
        got = d.agg(*[F.sum(F.col("w") * F.col(f"d{x[i]}") * F.col(f"d{x[j]}")) for i, j in _pairs(len(x))], *[F.sum(F.col("w") * F.col(f"d{c}") * F.col("dz")) for c in x]).first()
        xx = np.zeros((len(x), len(x)))
        for (i, j), v in zip(_pairs(len(x)), got, strict=False):
            xx[i, j] = xx[j, i] = v
        b, inv = _solve(xx, np.array(got[len(_pairs(len(x))) :], float))
        resid = F.col("dz") - sum((F.col(f"d{c}") * float(np.nan_to_num(v)) for c, v in zip(x, b, strict=True)), F.lit(0.0))
        d = d.withColumn("eta", F.col("z") - resid).withColumn("mu", F.col("n") * F.exp(F.greatest(F.least("eta", F.lit(50.0)), F.lit(-50.0))))
        cells = materialize(d, "cells")
        dev = cells.agg(2 * F.sum(F.when(F.col("y") > 0, F.col("y") * F.ln(F.col("y") / F.col("mu"))).otherwise(0.0) - (F.col("y") - F.col("mu")))).first()[0] or 0.0
        change = 1.0 if old is None else abs(dev - old) / max(1.0, abs(dev))
        if change <= tol and gap <= 1e-7:
            break
        # the inner projections are as exact as the outer step deserves
        old, gap = dev, max(1e-9, min(1e-3, change * 1e-2))
    if not clusters:
        return Fit(list(xs), b, inv, n)
    cols = [f"u{i}" for i in range(len(x))]
    scores = cells.select(*clusters, *[(F.col(f"d{c}") * (F.col("y") - F.col("mu"))).alias(u) for c, u in zip(x, cols, strict=True)])
    v, counts = _sandwich(scores, cols, inv, list(clusters), n)
    return Fit(list(xs), b, v, n, counts)


def event_columns(df: DataFrame, treat: Column, time: str, event: int, window: range, base: int = -1, prefix: str = "rel") -> tuple[DataFrame, list[str]]:
    """df with a column treat x 1[time - event = r] for each r of the window but the base, ends binned; and their names."""
    names = {}
    rel = F.greatest(F.least(F.col(time) - event, F.lit(window[-1])), F.lit(window[0]))
    for r in window:
        if r != base:
            names[f"{prefix}_{'m' if r < 0 else 'p'}{abs(r)}"] = F.when(rel == r, treat.cast("double")).otherwise(0.0)
    return df.withColumns(names), list(names)


def slope_by(df: DataFrame, groups: list[str], y: str, x: str) -> DataFrame:
    """(groups..., slope, intercept, r, n) of simple regressions, one per group, as built-in aggregates."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    return df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(F.when(both, F.col(y)), F.when(both, F.col(x))).alias("r"), F.count(F.when(both, 1)).alias("n"))


def ridge_gcv(x: np.ndarray, y: np.ndarray, alphas: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, alpha) of ridge regression with the strength of least generalised cross-validation error.

    For few rows and many columns: one decomposition of the rows' Gram matrix serves all strengths. x and y are centred.
    """
    alphas = np.logspace(-3, 4, 30) if alphas is None else alphas
    value, vec = np.linalg.eigh(x @ x.T)
    value, uy, best = np.maximum(value, 0), vec.T @ y, None
    for a in alphas:
        keep = value / (value + a)
        err = np.sum(((1 - keep) * uy) ** 2) / len(y)
        gcv = err / max((1 - keep.sum() / len(y)) ** 2, 1e-12)
        if best is None or gcv < best[0]:
            best = (gcv, a)
    return x.T @ (vec @ (uy / (value + best[1]))), float(best[1])


def ridge_gcv_moments(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, alphas: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """What ridge_gcv gives, for few columns and any number of rows: from the centred moments X'X, X'y and y'y of n rows."""
    alphas = np.logspace(-3, 4, 30) if alphas is None else alphas
    value, vec = np.linalg.eigh(xx)
    value, uy, best = np.maximum(value, 0), vec.T @ xy, None
    for a in alphas:
        # residuals: y'y - 2 b'X'y + b'X'X b in the basis of the eigenvectors
        err = (yy - np.sum(uy**2 * (value + 2 * a) / (value + a) ** 2)) / n
        gcv = err / max((1 - np.sum(value / (value + a)) / n) ** 2, 1e-12)
        if best is None or gcv < best[0]:
            best = (gcv, a)
    return vec @ (uy / (value + best[1])), float(best[1])
