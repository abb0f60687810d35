"""Word weights, centroids and nearest neighbours in DataFrame algebra and Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a dense anchor matrix that a task may hold; beyond it the anchors are read in slices.
ANCHOR_BYTES = 256 << 20


def term_counts(df: DataFrame, key: str, text: str, *, ngrams: int = 1) -> DataFrame:
    """(key, term, tf): counts of the words and n-grams up to `ngrams`; null and empty texts have none."""
    w = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def runs(n: int):
        joined = F.transform(F.sequence(F.lit(1), F.size("__w") - (n - 1)), lambda i: F.array_join(F.slice("__w", i, F.lit(n)), " "))
        return F.when(F.size("__w") >= n, joined).otherwise(F.array().cast("array<string>"))

    grams = F.concat(F.col("__w"), *[runs(n) for n in range(2, ngrams + 1)])
    return df.select(F.col(key), w.alias("__w")).select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, key: str, *, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(key, term, weight): (1 + ln tf) (1 + ln((1+n)/(1+df))) with unit length per key."""
    n = counts.select(key).distinct().count()
    df_ = counts.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    w = counts.join(df_, "term").withColumn("x", (1 + F.ln("tf")) * (1 + F.ln(F.lit(1.0 + n) / (1 + F.col("df")))))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("weight"))


def anchor_vocabulary(weights: DataFrame, key: str, anchors: DataFrame, *, least: int = 2, most: float = 0.85) -> DataFrame:
    """weights of the terms used by at least `least` and at most that share of the anchors, again of unit length."""
    n = anchors.count()
    keep = weights.join(anchors, key, "left_semi").groupBy("term").agg(F.count("*").alias("d")).filter((F.col("d") >= least) & (F.col("d") <= most * n)).select("term")
    kept = weights.join(keep, "term", "left_semi")
    norm = kept.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return kept.join(norm, key).select(key, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def centroids(weights: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """(label, term, weight): unit-length mean vectors over all records of a label."""
    n = labels.groupBy(label).agg(F.count("*").alias("n"))
    c = weights.join(labels, key).groupBy(label, "term").agg(F.sum("weight").alias("s")).join(n, label).withColumn("m", F.col("s") / F.col("n"))
    norm = c.groupBy(label).agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("norm"))
    return c.join(norm, label).select(label, "term", (F.col("m") / F.col("norm")).alias("weight"))


def contrast_weights(counts: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """(term, weight): the root of each term's chi-squared statistic over the labels, divided by the mean root."""
    j = counts.join(labels, key)
    size = labels.groupBy(label).agg(F.count("*").alias("size"))
    seen = j.groupBy("term", label).agg(F.sum("tf").alias("o"))
    total = seen.groupBy("term").agg(F.sum("o").alias("t"))
    n = labels.count()
    e = F.col("t") * F.col("size") / F.lit(float(n))
    # labels without the term add their expectation: sum over labels of e is t, over the seen ones it is joined
    chi = seen.join(total, "term").join(size, label).groupBy("term").agg((F.sum((F.col("o") - e) ** 2 / e) + F.first("t") - F.sum(e)).alias("chi"))
    return chi.withColumn("r", F.sqrt(F.greatest("chi", F.lit(0.0)))).crossJoin(F.broadcast(chi.agg(F.avg(F.sqrt(F.greatest("chi", F.lit(0.0)))).alias("m")))).select("term", (F.col("r") / F.col("m")).alias("weight"))


def nearest_label(weights: DataFrame, key: str, centre: DataFrame, label: str, *, floor: float = 0.01) -> DataFrame:
    """(key, label, score): the label of largest cosine at or above floor; ties take the smaller label."""
    s = weights.join(centre.withColumnRenamed("weight", "c"), "term").groupBy(key, label).agg(F.sum(F.col("weight") * F.col("c")).alias("score")).filter(F.col("score") >= floor)
    return s.groupBy(key).agg(F.min_by(F.struct(label, "score"), F.struct(-F.col("score"), F.col(label))).alias("x")).select(key, "x.*")


def knn(queries: DataFrame, anchors: DataFrame, key: str, vector: str, *, k: int = 3, floor: float = 0.05, power: float = 2.0) -> DataFrame:
    """(key, anchor, sim, weight): each query's k nearest anchors by cosine, weights sim^power, summing to 1 per query.

    Anchors below floor count nothing; a query that has none has no row. The anchors are a set of checked size: they go to the
    tasks in slices of at most ANCHOR_BYTES, and the best k of all slices are merged by an aggregate. Ties take the smaller id.
    """
    spark = queries.sparkSession
    n, width = anchors.count(), anchors.select(F.max(F.size(vector))).first()[0] or 0
    per = max(1, ANCHOR_BYTES // max(1, 8 * width))
    slices = -(-n // per)
    kind = queries.schema[key].dataType.simpleString()
    akind = anchors.schema[key].dataType
    parts = []
    for s in range(max(1, slices)):
        rows = anchors.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == s).select(key, vector).dropna().orderBy(key).toPandas() if n else pd.DataFrame({key: [], vector: []})
        ids = rows[key].tolist()
        mat = np.stack([np.asarray(v, np.float64) for v in rows[vector]]) if len(rows) else np.zeros((0, width), np.float64)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, mat = shared.value
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b) or not len(ids):
                    continue
                q = np.stack([np.asarray(v, np.float64) for v in b[vector]])
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
                sim = q @ mat.T
                top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), top.shape[1]), "anchor": [ids[j] for r in top for j in r], "sim": np.take_along_axis(sim, top, 1).ravel().astype(float)})

        parts.append(queries.select(key, vector).mapInPandas(run, f"`{key}` {kind}, anchor {akind.simpleString()}, sim double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(key)
    if slices > 1:
        out = out.withColumn("r", F.row_number().over(w.orderBy(F.desc("sim"), "anchor"))).filter(F.col("r") <= k).drop("r")
    out = out.filter(F.col("sim") >= floor).withColumn("p", F.pow("sim", F.lit(power)))
    return out.select(key, "anchor", "sim", (F.col("p") / F.sum("p").over(w)).alias("weight"))


def knn_diagnostics(weights: DataFrame, key: str) -> DataFrame:
    """(key, max_sim, mean_topk_sim, n_anchors)."""
    return weights.groupBy(key).agg(F.max("sim").alias("max_sim"), F.avg("sim").alias("mean_topk_sim"), F.count("*").alias("n_anchors"))


def impute(weights: DataFrame, key: str, values: DataFrame, anchor: str, value: str) -> DataFrame:
    """(key, value): the weighted mean of the anchors' values over the anchors that have one."""
    j = weights.join(values.select(F.col(anchor).alias("anchor"), value), "anchor").filter(F.col(value).isNotNull())
    return j.groupBy(key).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))


def shrink_shares(shares: DataFrame, unit: str, market: str, amount: str, alpha: float) -> DataFrame:
    """(unit, market, share): shares shrunk to the pooled shares, (T s + alpha prior) / (T + alpha); units of total 0 drop."""
    by = shares.groupBy(unit, market).agg(F.sum(amount).alias("a"))
    unit_total = by.groupBy(unit).agg(F.sum("a").alias("t")).filter("t > 0")
    prior = by.groupBy(market).agg(F.sum("a").alias("p"))
    prior = prior.crossJoin(F.broadcast(prior.agg(F.sum("p").alias("all")))).select(market, (F.col("p") / F.col("all")).alias("prior"))
    # a unit's row is dense over the markets, which are a list
    dense = unit_total.crossJoin(prior).join(by, [unit, market], "left")
    return dense.select(unit, market, ((F.coalesce("a", F.lit(0.0)) + F.lit(alpha) * F.col("prior")) / (F.col("t") + alpha)).alias("share"))


def char_counts(df: DataFrame, key: str, text: str, *, low: int = 3, high: int = 5) -> DataFrame:
    """(key, term, tf): counts of the character runs of low..high inside words that have a space on either side.

    A padded word shorter than low is one run of its own. Null and empty texts have none.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda x: x != "")

    def runs(p, n: int):
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    padded = df.select(key, F.explode(words).alias("__w")).select(key, F.concat(F.lit(" "), "__w", F.lit(" ")).alias("__p"))
    p = F.col("__p")
    grams = F.concat(F.when(F.length(p) < low, F.array(p)).otherwise(F.array().cast("array<string>")), *[runs(p, n) for n in range(low, high + 1)])
    return padded.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def concat_blocks(blocks: list[tuple[str, DataFrame, float]], key: str) -> DataFrame:
    """(key, term, weight): blocks (name, unit-length weights, factor) side by side, terms prefixed by their block's name."""
    parts = [w.select(key, F.concat(F.lit(f"{name}:"), "term").alias("term"), (F.col("weight") * factor).alias("weight")) for name, w, factor in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
