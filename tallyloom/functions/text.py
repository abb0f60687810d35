"""Text cleaning, extraction and stemming."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Greek letters by name, and Latin letters that have no decomposition.
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), strict=True))
UNDECOMPOSED = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n"}
# English function words.
STOP_WORDS = frozenset("a an and are as at be been but by for from had has have he her his if in into is it its not of on or our she so such than that the their them then there these they this to was we were which while who will with would you".split())


def fold(s: str | None) -> str | None:
    """Lower-case ASCII of a text: Greek letters by name, accents dropped, letters without decomposition by table."""
    if s is None:
        return None
    out = []
    for c in s.lower():
        c = GREEK.get(c) or UNDECOMPOSED.get(c) or c
        out.append("".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii()))
    return "".join(out)


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix tables of the 1980 algorithm.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    """The stem of a lower-case word by Porter's algorithm of 1980."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and any(_vowel(base, i) for i in range(len(base))):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_text(s: pd.Series) -> pd.Series:
    """Stems of the words of more than two letters that are no stop words and no numbers, in order."""
    seen: dict[str, str] = {}

    def one(t: str) -> str:
        out = []
        for w in re.findall(r"[a-z]+|\d+", t.lower()):
            if len(w) > 2 and w not in STOP_WORDS and not w.isdigit():
                if w not in seen:
                    seen[w] = porter(w)
                out.append(seen[w])
        return " ".join(out)

    return s.map(one, na_action="ignore")


# The cleaning steps by name; each pattern gives way to its replacement.
STEPS = {
    "urls": (r"https?://\S+", " "),
    "catalog_refs": (r"(?i)\b(?:cat(?:alog)?|item|stock|ref)\s*(?:no\.?|number|#)?\s*[:#]?\s*\d[\w-]*", " "),
    "lots": (r"(?i)\blot\s*#?\s*\d+", " "),
    "money": (r"[$€£]\s*\d[\d,]*(?:\.\d+)?", " "),
    "key_values": (r"(?i)\b(?:unit|size|color|brand)\s*:\s*\S+", " "),
    "sequences": (r"(?i)\b[acgtu]{12,}\b", " "),
    "packs": (r"(?i)\b\d+\s*/\s*(?:pk|cs|bx|ea)\b", " "),
    "brackets": (r"[\[\](){}]", " "),
    "long_numbers": (r"\b\d{4,}\b", " "),
    "signs": (r"[^\p{L}\p{N}%.+-]+", " "),
    "spaces": (r"\s+", " "),
}


def clean(c: Column, steps: list[str] | None = None) -> Column:
    """Lower case, the steps in order, then words without stop words or single characters, each once; unknown steps raise."""
    c = F.lower(c)
    for s in steps or list(STEPS):
        if s not in STEPS:
            raise KeyError(f"no cleaning step {s!r}")
        c = F.regexp_replace(c, *STEPS[s])
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.array_join(F.array_distinct(F.filter(F.split(F.trim(c), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))), " ")


def extract_all(c: Column, patterns: list[str]) -> Column:
    """All matches of the patterns, pattern by pattern, joined by '; ' without repeats; empty for null."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.array().cast("array<string>")) for p in patterns]))), "; ")


def keyword_pattern(words: list[str], *, case: bool = False) -> str:
    """One expression for words or phrases: on word borders, any or no separator inside, plural s or es allowed; *x* is a part."""
    parts = []
    for w in words:
        core, left, right = w.strip("*"), w.startswith("*"), w.endswith("*")
        body = r"[\s\-_/]*".join(re.escape(p) for p in re.split(r"[\s\-_/]+", core.strip()))
        plural = "" if right or core.endswith("s") else "(?:e?s)?"
        parts.append(("" if left else r"(?<![A-Za-z0-9])") + body + plural + ("" if right else r"(?![A-Za-z0-9])"))
    return ("" if case else "(?i)") + "(?:" + "|".join(parts or ["(?!)"]) + ")"


def supplier_token(c: Column) -> Column:
    """supp_ and the first three words of three letters or more, without legal forms."""
    legal = F.array(*[F.lit(x) for x in ("inc", "ltd", "llc", "gmbh", "corp", "company", "supply", "scientific")])
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z ]+", " ")), " +"), lambda x: (F.length(x) >= 3) & ~F.array_contains(legal, x))
    return F.concat(F.lit("supp_"), F.array_join(F.slice(w, 1, 3), "_"))


def grant_parts(c: Column) -> Column:
    """struct(activity, institute, serial) of ids such as '5R01GM012345-07' or 'GM 12345'; serials padded to six digits."""
    full, short = r"(?i)^\s*\d?([A-Z]\d{2})\s*([A-Z]{2})[\s-]*(\d{4,6})", r"(?i)^\s*([A-Z]{2})[\s-]*(\d{4,6})"
    g = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(F.upper(g(full, 1)).alias("activity"), F.upper(F.coalesce(g(full, 2), g(short, 1))).alias("institute"), F.lpad(F.coalesce(g(full, 3), g(short, 2)), 6, "0").alias("serial"))


def head_term(c: Column) -> Column:
    """The text before its last comma, unless it speaks of models."""
    h = F.regexp_extract(c, "^(.*),[^,]*$", 1)
    return F.when(c.contains("Models") | (h == ""), c).otherwise(h)
