"""Names of firms, institutions and people: scores, blocking and assignment."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import fold
from tallyloom.operators.graph import greedy_stars
from tallyloom.operators.skew import salted_join
from tallyloom.runtime import materialize

# Words that say nothing about which firm or institution is meant.
LEGAL = frozenset("inc incorporated ltd limited llc corp corporation co company gmbh ag sa plc".split())
GENERIC = frozenset("scientific supply supplies science sciences international group the of and".split())


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = where.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    """200 x longest common subsequence / total length; 100 for two empty texts."""
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of comparing the shared words with either side's sorted words; 100 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 100.0
    p, q = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    return max(ratio(p, q), *((ratio(both, p), ratio(both, q)) if both else (0.0, 0.0)))


def normal_name(s: str | None) -> str:
    """ASCII words in lower case without legal forms and trailing generic words."""
    w = [x for x in re.findall(r"[a-z0-9]+", fold(s or "") or "") if x not in LEGAL]
    while len(w) > 1 and w[-1] in GENERIC:
        w.pop()
    return " ".join(w)


@F.pandas_udf(T.StringType())
def normal_name_udf(s: pd.Series) -> pd.Series:
    return s.map(lru_cache(maxsize=50_000)(normal_name))


@F.pandas_udf(T.DoubleType())
def same_firm(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 for equal without spaces or a safe subset of words, else the token-sort score."""

    def one(x: str, y: str) -> float:
        if x.replace(" ", "") == y.replace(" ", ""):
            return 100.0
        small, large = sorted((set(x.split()), set(y.split())), key=len)
        if small <= large and max(map(len, small), default=0) >= 5 and token_set(x, y) == 100:
            return 100.0
        return token_sort(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def resolve_suppliers(names: DataFrame, column: str, *, threshold: float = 92.0) -> DataFrame:
    """(column, parent): each distinct name with the name that stands for it.

    Names are normalised; those that share a word's first three letters are scored; going through the normal forms by
    (length, text), each free one takes the free ones that score at least the threshold. The parent shown is the smallest
    original spelling of the parent's form. Null and blank names have no parent and no row.
    """
    raw = names.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("__n", normal_name_udf(F.col(column))).filter("__n <> ''")
    raw = materialize(raw, "names")
    forms = raw.groupBy(F.col("__n").alias("node")).agg(F.min(column).alias("shown")).withColumn("len", F.length("node"))
    blocks = forms.select("node", F.explode(F.array_distinct(F.transform(F.split("node", " "), lambda w: F.substring(w, 1, 3)))).alias("block"))
    pairs = blocks.withColumnRenamed("node", "a").join(blocks.withColumnRenamed("node", "b"), "block").filter("a < b").select("a", "b").distinct()
    links = materialize(pairs.filter(same_firm("a", "b") >= threshold), "links")
    stars = greedy_stars(forms.select("node", "len"), links, ["len", "node"])
    shown = forms.select(F.col("node").alias("parent"), F.col("shown"))
    return raw.join(stars.join(shown, "parent").select(F.col("node").alias("__n"), F.col("shown").alias("parent")), "__n").select(column, "parent")


@F.pandas_udf(T.DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def crosswalk(left: DataFrame, right: DataFrame, lname: str, rname: str, *, threshold: float = 88.0, top: int = 40) -> DataFrame:
    """(lname, rname, score, rank): for each left name the right names that score at least the threshold, best first.

    Every pair of normal forms that share a word is scored once, at its first shared word; words that many forms have are
    joined in parts. rank goes by exact form, score, then name; top is the number wanted of each.
    """
    l_ = materialize(left.select(lname).distinct().dropna().withColumn("__l", normal_name_udf(lname)).filter("__l <> ''"), "left")
    r = materialize(right.select(rname).distinct().dropna().withColumn("__r", normal_name_udf(rname)).filter("__r <> ''"), "right")
    words = lambda df, c: df.select(c).distinct().withColumn(f"{c}w", F.array_distinct(F.split(c, " "))).withColumn("t", F.explode(f"{c}w"))
    mine = materialize(words(l_, "__l"), "words")
    post = words(r, "__r").join(mine.groupBy("t").agg(F.count("*").alias("__n")), "t")
    pairs = salted_join(mine, post, ["t"], size="__n", spread_by=["__l"]).filter(F.col("t") == F.array_min(F.array_intersect("__lw", "__rw")))
    scored = materialize(pairs.select("__l", "__r").withColumn("score", token_set_udf("__l", "__r")).filter(F.col("score") >= threshold), "scored")
    named = l_.join(scored, "__l").join(r, "__r")
    order = Window.partitionBy(lname).orderBy(F.desc(F.col("__l") == F.col("__r")), F.desc("score"), rname)
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(lname, rname, "score", "rank")


def person_score(a_sur: str, a_given: str, b_sur: str, b_given: str) -> float:
    """.45 x surname + .55 x given names: initials agree or not, a prefix counts 92, middle names that conflict cost 8."""
    sur = ratio(a_sur, b_sur)
    x, y = a_given.split(), b_given.split()
    if not x or not y:
        return 0.45 * sur
    f, g = x[0], y[0]
    if len(f) == 1 or len(g) == 1:
        first = 100.0 if f[0] == g[0] else 0.0
    elif f.startswith(g) or g.startswith(f):
        first = 100.0 if f == g else 92.0
    else:
        first = ratio(f, g)
    out = 0.45 * sur + 0.55 * first
    if len(x) > 1 and len(y) > 1:
        m, n = x[1], y[1]
        out -= 8 if m[0] != n[0] else 6 if (len(m) > 1 and len(n) > 1 and m != n) else 0
    return max(0.0, out)


@F.pandas_udf(T.DoubleType())
def person_score_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([person_score(*map(lambda s: fold(s) or "", t)) for t in zip(a, b, c, d, strict=True)], dtype=float)


def match_people(pis: DataFrame, authors: DataFrame, edges: DataFrame, *, place: float = 88.0, name: float = 94.0, clear: float = 96.0, gap: float = 6.0, support: int = 3) -> DataFrame:
    """(pi_id, athr_id, score, pass): grant holders to authors in three passes.

    pis: pi_id, surname, given, org. authors: athr_id, surname, given, inst. edges: org, inst. First the best author of a linked
    institution with the same surname key and initial, at score `place`. Then by name alone, if one author alone reaches
    `name`, or the best reaches `clear` and leads by `gap`. Then pairs (org, inst) that `support` matches of the second pass share
    become edges, and the first pass runs again for who is left. Ties take the smaller author id.
    """
    key = lambda df: df.withColumn("k", F.regexp_replace(F.lower("surname"), "[^a-z]", "")).withColumn("i", F.lower(F.substring("given", 1, 1)))
    p, a = materialize(key(pis), "pis"), materialize(key(authors), "authors").select("athr_id", F.col("surname").alias("s2"), F.col("given").alias("g2"), "inst", "k", "i")
    scored = lambda j: j.withColumn("score", person_score_udf("surname", "given", "s2", "g2"))

    def linked(rest: DataFrame, via: DataFrame, n: int) -> DataFrame:
        j = scored(rest.join(via.select("org", "inst").distinct(), "org").join(a, ["inst", "k", "i"])).filter(F.col("score") >= place)
        return j.groupBy("pi_id").agg(F.min_by(F.struct("athr_id", "score"), F.struct(-F.col("score"), F.col("athr_id"))).alias("x")).select("pi_id", "x.*", F.lit(n).alias("pass"))

    one = materialize(linked(p, edges, 1), "pass1")
    rest = p.join(one, "pi_id", "left_anti")
    by = scored(rest.join(a.drop("inst").distinct(), ["k", "i"])).filter(F.col("score") >= name).select("pi_id", "org", "athr_id", "score").distinct()
    w = Window.partitionBy("pi_id").orderBy(F.desc("score"), "athr_id")
    by = by.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("r = 1")
    two = materialize(by.filter(F.col("second").isNull() | ((F.col("score") >= clear) & (F.col("score") - F.col("second") >= gap))).select("pi_id", "org", "athr_id", "score"), "pass2")
    learnt = two.join(a.select("athr_id", "inst").distinct(), "athr_id").groupBy("org", "inst").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    three = linked(rest.join(two, "pi_id", "left_anti"), learnt, 3)
    return one.unionByName(two.select("pi_id", "athr_id", "score", F.lit(2).alias("pass"))).unionByName(three)
