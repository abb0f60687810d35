"""Listings of one product: a dictionary mined from trusted listings reads all of them.

Trusted are the listings that part their fields by a sign of their own. From them come the brand-model phrases (fields such as
"by X Y model C3", of any words and any model), the kinds of item (fields that keep to one category), which kinds are
one (they meet in listings alike in all else), and praise (fields that spread over all categories alike); terms need a fixed
number of mentions, whatever the size of the table. An Aho-Corasick automaton finds all these and the trade vocabulary's
phrases in every listing; of overlapping ones the longest win, misspelt words being read as the dictionary's word a few edits
away; sizes and pack counts are brought to one unit. Every word that is left over is kept as `rest` and compared too, so what
no dictionary knows (a material, a model) keeps listings apart. Listings whose kind, size, pack, material or grade, feature, maker,
model and rest agree are one product.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.spelling import Near, edits
from tallyloom.runtime import materialize

# The default trade vocabulary. Phrases for one material or grade.
MATERIALS = {
    "borosilicate": ["borosilicate", "borosilicate glass", "boro glass", "borosilicate 3 3"],
    "soda-lime": ["soda lime glass", "soda lime"],
    "pp": ["pp", "pp plastic", "polypropylene", "poly propylene"],
    "hdpe": ["hdpe", "hd polyethylene", "high density polyethylene"],
    "ldpe": ["ldpe", "ld polyethylene", "low density polyethylene"],
    "ps": ["ps", "polystyrene", "poly styrene", "ps plastic"],
    "pc": ["pc plastic", "polycarbonate", "poly carbonate"],
    "ptfe": ["ptfe", "teflon", "polytetrafluoroethylene"],
    "stainless": ["s s", "stainless", "stainless steel", "inox steel", "inox"],
    "carbon steel": ["cs steel", "carbon steel"],
    "chromed brass": ["chromed brass", "chrome plated brass", "brass chromed"],
    "bare brass": ["bare brass", "unplated brass", "brass unplated"],
    "aluminium": ["alu", "aluminium", "aluminum"],
    "titanium": ["titanium", "titanium alloy", "ti metal"],
    "hplc": ["hplc", "hplc grade", "grade hplc", "for hplc"],
    "acs": ["acs", "a c s grade", "acs grade", "acs reagent grade", "reagent acs", "acs reagent"],
    "molecular biology": ["mol bio grade", "molecular biology grade", "mol biol grade", "molecular biology"],
    "technical": ["technical grade", "tech grade", "technical"],
}
# Phrases for one feature and its opposite.
FEATURES = {
    "lid": ["with lid", "w lid", "incl lid", "lid included"],
    "no lid": ["without lid", "no lid", "w o lid", "lid not included"],
    "graduated": ["graduated", "with graduations", "printed scale"],
    "not graduated": ["plain wall", "no graduations", "unmarked wall", "not graduated", "ungraduated"],
    "sterile": ["sterile", "sterilised", "sterilized", "sterilized ready to use", "ready to use"],
    "not sterile": ["not sterilised", "not sterilized", "non sterile", "unsterile", "not sterile"],
    "amber": ["amber", "brown amber", "amber tinted"],
    "clear": ["clear", "clear colour", "clear color", "transparent"],
    "stabilised": ["stabilised", "stabilized", "with stabilizer", "with stabiliser"],
    "not stabilised": ["no stabilizer", "no stabiliser", "unstabilised", "unstabilized", "without stabilizer"],
    "anhydrous": ["anhydrous", "anhyd", "water free"],
    "monohydrate": ["monohydrate", "mono hydrate", "1 hydrate"],
    "powder": ["powder", "powdered", "in powder form"],
    "solution": ["solution", "in solution", "dissolved liquid", "dissolved"],
    "glass bottle": ["glass btl", "in glass bottle", "glass bottle packed", "glass bottle"],
    "plastic bottle": ["plastic btl", "in plastic bottle", "plastic bottle packed", "plastic bottle"],
    "serrated": ["serrated", "with serrations", "toothed grip"],
    "smooth": ["smooth", "smooth grip", "no serrations", "without serrations"],
    "curved": ["curved", "curved shape", "bent tip"],
    "straight": ["straight", "straight shape", "unbent tip"],
    "locking": ["locking", "lockable", "with lock"],
    "no lock": ["non locking", "without lock", "no lock"],
    "left": ["left handed", "for left hand", "lefty version"],
    "right": ["right handed", "for right hand", "righty version"],
}
# Words that praise an article and say nothing about it; more are mined.
PRAISE = (
    "award winning; best value; bestseller; economy choice; fast dispatch; free returns; great deal; hot seller; ideal for everyday work; "
    "limited stock; new; premium; pro line; special offer; top quality; trusted by labs"
).split("; ")
#: {attribute: {value: phrases}} of a trade; give another to attributes() for other catalogues, or an empty one.
VOCABULARY = {"material": MATERIALS, "feature": FEATURES, "praise": {p: [p] for p in PRAISE}}
# Units with their size in the smallest one.
UNITS = {u: (dim, Decimal(k)) for dim, table in {
    "v": {1: "ul µl μl microliter microlitre microliters", 1000: "ml cc milliliter millilitre milliliters", 1_000_000: "l liter litre liters litres"},
    "d": {1: "mm millimeter millimetre millimeters", 10: "cm centimeter centimetre centimeters", 1000: "m meter metre meters"},
    "m": {1: "mg milligram milligrams", 1000: "g gm gram grams", 1_000_000: "kg kilo kilogram kilograms"},
}.items() for k, names in table.items() for u in names.split()}
# a number has 15 digits at most, so a long run of digits is read in linear time
NUMBER = r"\d{1,3}(?:,\d{3}){1,4}(?:\.\d{1,9})?|\d{1,15}(?:\.\d{1,9})?|\.\d{1,9}"
SIZE = re.compile(rf"(?<![\w.])({NUMBER})\s*-?\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\.?(?![a-zµμ0-9])")
PURITY = re.compile(r"(?:purity\s*|>=\s*|≥\s*)(\d{1,3}(?:\.\d{1,9})?)\s*%|(?<![\d.])(\d{1,3}(?:\.\d{1,9})?)\s*(?:%\s*pur\w*|pct\.?\s*pur\w*)")
CODE = re.compile(r"(?:(?:item|stock|cat|art|ref)\.?\s*(?:no\.?|#)|\bcat\b)\s*#?\d{3,}")
N = rf"({NUMBER})"
PACKS = [(re.compile(rf"{N}\s*(?:bags|packs|boxes) of\s*{N}"), "product"), (re.compile(rf"{N}\s*(?:dozen|dz|doz)\b"), "dozen"), (re.compile(r"\b(?:one|a)\s*(?:dozen|dz)\b|\b(?:dozen)\b"), "one dozen")] + [
    (re.compile(p), "n") for p in (rf"\b(?:pack|box|set|case|bag|carton) of\s*{N}", rf"\b(?:case|pack|box)\s*/\s*{N}", rf"\bpk\s*{N}", rf"\bqty\.?\s*{N}", rf"(?<![\w.]){N}\s*/\s*(?:pk|ea|pack|case)\b", rf"(?<![\w.]){N}\s*(?:per case|per pack|pcs?|ct|ea|pieces)\b")
] + [(re.compile(r"\b(?:single|each)\b"), "one")]
CUES, MODELS = ("mfr", "by", "maker", "from"), ("model", "mdl", "series")
PLAIN = frozenset("for in the of with and type use lab".split())
SPLIT = r" \| |; | - "
NAME, CODE_LIKE = r"[a-z0-9][a-z0-9&'.]*(?: [a-z0-9&'.]*[a-z][a-z0-9&'.]*){0,2}?", r"[a-z0-9][a-z0-9./-]*"
#: A field that names a maker and a model: with a cue or "brand" before, or a word for model between; else the model is a letter or has a digit.
BRAND_MODEL = rf"^ ?(?:(?:mfr|by|maker|from)\.? )?({NAME})(?: brand)? (?:model|mdl|series)[. ] ?({CODE_LIKE}) ?$|^ ?(?:mfr|by|maker|from)\.? ({NAME})(?: brand)? ([a-z]|[a-z]*[0-9][a-z0-9./-]*) ?$"
LEAST_COUNT, MAX_TERMS = 3, 1_000_000
#: A longer field is a sentence and no name of maker and model.
FIELD_LENGTH = 100
#: A word is a misspelling of one so near that is this many times as frequent.
MISSPELT = 10
#: A field spreads like praise if, with so many mentions, the categories where it is rare (a quarter of what its share there would be) hold no more than this share of all fields, and it is not rare in so many categories.
SPREAD_COUNT, SPREAD_MISSED, SPREAD_RARE, SPREAD_CATEGORIES = 30, 0.3, 0.25, 8
#: Kinds that share a word differ if they would meet this often in listings alike in all else but meet less than this share of it.
MEET_COUNT, MEET_SHARE = 8, 0.25
HIDE = {48 + d: 0xE000 + d for d in range(10)}
SHOW = {v: k for k, v in HIDE.items()}


def flat(text: str) -> str:
    """Lower case, NFKC, one space."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


def number(s: str) -> Decimal:
    return Decimal(s.replace(",", ""))


def _phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^a-z]+", " "))


def _named(c: Column) -> Column:
    """[maker, model] of a field that names both, else null; one pass of the pattern."""
    return F.when(c.contains(" ") & (F.length(c) <= FIELD_LENGTH), F.split(F.nullif(F.regexp_replace(c, BRAND_MODEL, "$1$3\t$2$4"), c), "\t"))


def mine(listings: DataFrame, key: str = "listing_id", text: str = "cleaned_description", category: str = "category", vocabulary: dict = VOCABULARY) -> dict:
    """{'words': right words, 'makers': [...], 'models': [(maker, model)...], 'kinds': {phrase: kind}, 'praise': [...]}, counted over all listings.

    A term enters with LEAST_COUNT mentions, in a table of any size, unless it or a word of it is a misspelling (see right_words).
    What is collected are the distinct terms of so many mentions, misspellings among them, checked against MAX_TERMS; pairs of
    maker and model beyond that are left out, as the maker alone and the model's place after it read the same.
    """
    low = listings.select(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ").alias("t"), F.lower(F.trim(F.col(category))).alias("c")).filter("t is not null")
    words = low.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[a-z]{2,}"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    fields = low.filter(F.col("t").rlike(SPLIT)).select("c", F.split("t", SPLIT).alias("ps"))
    pieces = fields.select("c", F.explode("ps").alias("p"))
    named = pieces.select(_named(F.col("p")).alias("x")).filter("x is not null").select(F.col("x")[0].alias("w"), F.col("x")[1].alias("c")).groupBy("w", "c").agg(F.count("*").alias("n"))
    named = materialize(named, "named")
    makers = named.groupBy("w").agg(F.sum("n").alias("n"))
    by_category = pieces.filter(~F.col("p").rlike(r"[0-9]") & F.col("c").isNotNull()).groupBy(_phrase(F.col("p")).alias("w"), "c").agg(F.count("*").alias("k"))
    by_category = materialize(by_category, "fields")
    # how much of all fields lies in the categories where a field is as frequent as elsewhere, give or take
    shares = by_category.groupBy("c").agg(F.sum("k").alias("all"))
    total = by_category.agg(F.sum("k").alias("total"))
    kinds = by_category.groupBy("w").agg(F.max_by("c", F.struct("k", "c")).alias("c"), F.max("k").alias("k"), F.sum("k").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    often = kinds.filter(f"n >= {SPREAD_COUNT}").select("w", "n")
    spread = by_category.join(often, "w").join(shares, "c").crossJoin(total).withColumn("share", F.col("all") / F.col("total"))  # total is one row
    spread = spread.groupBy("w").agg(F.first("n").alias("n"), F.sum(F.when(F.col("k") >= SPREAD_RARE * F.col("share") * F.col("n"), F.col("share"))).alias("met"), F.count(F.when(F.col("k") >= SPREAD_RARE * F.col("share") * F.col("n"), 1)).alias("places"))
    spread = spread.filter((F.col("met") >= 1 - SPREAD_MISSED) & (F.col("places") >= SPREAD_CATEGORIES))
    none, zero = F.lit(""), F.lit(0).cast("long")
    as_rows = lambda what, df, c=none, k=zero, n=F.col("n"): df.select(F.lit(what).alias("what"), "w", c.alias("c"), k.cast("long").alias("k"), n.cast("long").alias("n"))
    rows = as_rows("word", words).unionByName(as_rows("maker", makers)).unionByName(as_rows("kind", kinds.filter("k >= 0.35 * n"), F.col("c"), F.col("k"))).unionByName(as_rows("praise", spread))
    got = rows.filter(F.col("n") >= LEAST_COUNT).limit(MAX_TERMS + 1).toPandas()
    if len(got) > MAX_TERMS:
        raise ValueError("the mined dictionary is too large")
    count = {what: dict(zip(g["w"], g["n"].astype(int), strict=True)) for what, g in got.groupby("what")}
    right = right_words(count.get("word", {}))
    fixed = {p for table in vocabulary.values() for ps in table.values() for p in ps}
    makers_right = right_words(count.get("maker", {}))
    heard = {m for m in makers_right if not set(m.split()) & {*MODELS, "brand"} and m not in fixed and any(re.search(r"\d", w) or len(w) > 2 and w in right and w not in PLAIN for w in m.split())}
    praise = {w for w in count.get("praise", {}) if w and w not in fixed and w not in heard}
    no_kind = {w for m in heard for w in m.split()} | {"model", "mdl", "series", "brand", "dozen", "dz", "each", "single"}
    of, right_kinds = {}, right_words(count.get("kind", {}))
    for r in got[got["what"] == "kind"].itertuples():
        ws = {x for x in r.w.split() if len(x) > 1}
        if ws and r.w in right_kinds and r.w not in fixed and r.w not in praise and ws <= right and not set(r.w.split()) & no_kind:
            of[r.w] = r.c
    models = named.filter(F.col("w").isin(*sorted(heard)) & (F.col("n") >= LEAST_COUNT)) if len(heard) < 1000 else named.filter(F.col("n") >= LEAST_COUNT)
    pairs = sorted((r.w, r.c) for r in models.select("w", "c").limit(MAX_TERMS).collect() if r.w in heard)
    meets = _meetings(fields, sorted(of))
    return {"words": sorted(right), "makers": sorted(heard), "models": pairs, "kinds": same_kinds(of, meets), "praise": sorted(praise)}


def _meetings(fields: DataFrame, kinds: list[str]) -> dict[tuple[str, str], int]:
    """How many pairs of trusted listings alike in category, maker, model and size name the two kinds (a kind and itself too).

    Listings are counted by group and kind before they meet; of kinds no pair of which ever meets there is no entry. Listings
    of the same fields, in any order and but for the seller's number, count once: a copy repeats its kind's name too, so it is
    no evidence that this name is always used.
    """
    if not kinds:
        return {}
    first = lambda f: F.get(F.array_compact(F.transform("ps", f)), F.lit(0))
    size = first(lambda p: F.nullif(F.regexp_extract(p, rf"^ ?((?:{NUMBER}) ?-?(?:{'|'.join(sorted(UNITS, key=len, reverse=True))}))\.? ?$", 1), F.lit("")))
    known = fields.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    said = F.array_sort(F.array_distinct(F.filter(F.transform("ps", F.trim), lambda p: ~p.rlike(CODE.pattern))))
    rows = fields.select("c", first(_named).alias("named"), F.regexp_replace(size, "[ -]", "").alias("size"), F.xxhash64(said).alias("said"), "ps").filter("c is not null and named is not null and size is not null")
    rows = rows.dropDuplicates(["c", "said"]).select("c", "named", "size", F.explode(F.transform("ps", _phrase)).alias("kind"))
    rows = rows.join(known, "kind").groupBy("c", "named", "size", "kind").agg(F.count("*").alias("n"))
    other = rows.select("c", "named", "size", F.col("kind").alias("other"), F.col("n").alias("m"))
    both = rows.join(other, ["c", "named", "size"]).filter("kind <= other").groupBy("kind", "other").agg(F.sum(F.when(F.col("kind") == F.col("other"), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("m"))).alias("n")).filter("n > 0")
    got = both.limit(MAX_TERMS + 1).collect()
    if len(got) > MAX_TERMS:
        raise ValueError("too many kinds that meet")
    return {(r.kind, r.other): int(r.n) for r in got}


def right_words(counts: dict[str, int]) -> set[str]:
    """The words but for misspellings: those an edit (two from seven letters on) away from a word MISSPELT times as frequent.

    A change of a digit is no misspelling.
    """
    near = Near((w for w, n in counts.items() if n >= MISSPELT * LEAST_COUNT), 2)
    digits = lambda w: re.sub(r"\D", "", w)
    return {w for w, n in counts.items() if not any(counts[v] >= MISSPELT * n and digits(v) == digits(w) for _, v in near.find(w, 1 if len(w) < 7 else 2))}


def same_kinds(of: dict[str, str], meets: dict[tuple[str, str], int] | None = None) -> dict[str, str]:
    """Phrases of one category that share a word (by its first four letters) name one kind: the first of them in order.

    Not so if the listings speak against it: as many as are alike in all else name each by itself, yet hardly ever the other.
    """
    parent, meets = {w: w for w in of}, meets or {}

    def root(w: str) -> str:
        while parent[w] != w:
            w = parent[w]
        return w

    def apart(a: str, b: str) -> bool:
        a, b = sorted((a, b))
        want = (meets.get((a, a), 0) * meets.get((b, b), 0)) ** 0.5
        return want >= MEET_COUNT and meets.get((a, b), 0) < MEET_SHARE * want

    by: dict[tuple[str, str], list[str]] = {}
    for w in sorted(of):
        for x in sorted({x[:4] for x in w.split() if len(x) > 2 and x not in PLAIN}):
            for v in by.setdefault((of[w], x), []):
                if not apart(v, w):
                    a, b = sorted((root(v), root(w)))
                    parent[b] = a
            by[of[w], x].append(w)
    return {w: root(w) for w in of}


class Reader:
    """The dictionary compiled in a worker."""

    def __init__(self, words: tuple, makers: tuple, kinds: tuple, models: tuple = (), praise: tuple = (), vocabulary: dict = VOCABULARY):
        self.kinds = {p: k for p, k in kinds if len(p) > 4}
        self.words_of: dict[str, set[str]] = {}
        for p, k in kinds:
            self.words_of.setdefault(k, set()).update(p.split())
        self.auto = ahocorasick.Automaton()
        phrases: dict[str, tuple[str, object]] = {}
        for name, table in vocabulary.items():
            for value, ps in table.items():
                for p in ps:
                    phrases[p] = (name, value)
        for m in makers:
            phrases.setdefault(" ".join(_tokens(m)), ("maker", (m, None)))
        for m, c in models:
            phrases.setdefault(" ".join(_tokens(f"{m} {c}")), ("maker", (m, "".join(_tokens(c)))))
        for p, kind in kinds:
            phrases.setdefault(p, ("kind", kind))
            core = " ".join(w for w in p.split() if w not in PLAIN)
            if core:
                phrases.setdefault(core, ("kind", kind))
        for p in praise:
            phrases.setdefault(p, ("praise", p))
        for p, (what, value) in phrases.items():
            self.auto.add_word(f" {p} ", (len(p) + 2, len(p.split()), what, value))
        if len(self.auto):
            self.auto.make_automaton()
        loose = {(frozenset(p.split()) - PLAIN, kind) for p, kind in kinds}
        self.loose = sorted(((w, k) for w, k in loose if len(w) > 1), key=lambda x: (-len(x[0]), x[1], sorted(x[0])))
        self.by_word: dict[str, list[tuple[frozenset, str]]] = {}
        for need, kind in self.loose:
            self.by_word.setdefault(min(need), []).append((need, kind))
        style = PLAIN | set(CUES) | set(MODELS) | {"brand"}
        self.parts = {w for p, (what, _) in phrases.items() if what != "maker" for w in p.split()} | style
        means = {w for p in phrases for w in p.split()} | style
        self.known = means | set(words)
        # a misspelling is read as a word that means something here, and not as one that is merely frequent
        self.near = Near((w for w in means if len(w) > 2 and w.isalpha()), 2)
        self.near_kinds, self.kind_sizes = Near(self.kinds, 2), sorted({len(p.split()) for p in self.kinds})
        digit = [re.escape(m) for m in sorted(makers, key=len, reverse=True) if re.search(r"\d", m)]
        cue = rf"|(?:(?:by|mfr|maker|from)\.?\s+(?:{'|'.join(digit)})\b)|\b(?:{'|'.join(digit)})(?=\s+(?:brand|model|mdl|series)\b)" if digit else ""
        self.hide = re.compile(rf"\b(?:model|mdl|series)(?:\.\s*|\s+){CODE_LIKE}{cue}")
        self.spell = lru_cache(maxsize=100_000)(self._spell)

    def _spell(self, w: str) -> str:
        if w in self.known or len(w) < 4:
            return w
        found = [x for x in self.near.find(w, 1 if len(w) < 7 else 2) if len(x[1]) > 3 or len(w) == 4]
        return min(found, key=lambda x: (x[0], x[1] not in PLAIN, x[1]))[1] if found else w

    def _note(self, w: str, was: dict[str, str]) -> str:
        """The word as read; what was read as another word is noted in `was`, which a word written right takes off again."""
        x = self.spell(w)
        was[x] = w if x != w and was.get(x) != x else x
        return x

    def _meant(self, w: str, kind: str | None) -> bool:
        """Is the misspelt word as near to a word of the kind's names as to any other word?"""
        return any(edits(w, x, 1 if len(w) < 7 else 2) <= edits(w, self.spell(w), 2) for x in self.words_of.get(kind, ()) if len(x) > 3)

    def _idle(self, w: str, kind: str | None) -> bool:
        """Does the word say nothing more: a filling word, a word of the kind's names, or either misspelt?"""
        own = self.words_of.get(kind, ())
        return w in PLAIN or w in own or (w not in self.known and w.isalpha() and len(w) < 5 and any(len(x) > 2 and edits(w, x, 1) <= 1 for x in (*PLAIN, *own)))

    def read(self, text: str) -> dict[str, str]:
        """The attributes a listing states; of several values of one attribute the first, of features all; the other words as `rest`."""
        t = flat(text)
        was: dict[str, str] = {}
        t = re.sub(r"(?<![a-z])[a-z]{4,}(?![0-9])", lambda m: self._note(m.group(), was), t)
        # digits of makers and models are no sizes or counts
        t = self.hide.sub(lambda m: m.group().translate(HIDE), t)
        out: dict[str, str] = {}
        t = CODE.sub(" | ", t)
        m = PURITY.search(t)
        if m:
            out["material"] = f"purity {number(m.group(1) or m.group(2)).normalize()}"
            t = t[: m.start()] + " | " + t[m.end() :]
        m = SIZE.search(t)
        if m:
            dim, k = UNITS[m.group(2)]
            out["size"] = f"{dim}{(number(m.group(1)) * k).normalize():f}"
            t = t[: m.start()] + " | " + t[m.end() :]
        article = False
        for pattern, how in PACKS:
            m = pattern.search(t)
            if m:
                n = {"one": lambda: 1, "one dozen": lambda: 12, "n": lambda: number(m.group(1)), "dozen": lambda: 12 * number(m.group(1)), "product": lambda: number(m.group(1)) * number(m.group(2))}[how]()
                out["pack"] = f"{Decimal(n).normalize():f}"
                # "velquor a dozen": the letter may be the model
                article = m.group()[0] == "a" and bool(re.search(r"[a-z0-9.]\s$", t[: m.start()]))
                t = t[: m.start()] + (" a | " if article else " | ") + t[m.end() :]
                break
        words, styled, branded, pending = [], [], [], False
        for w in _tokens(t):
            if w in MODELS:
                pending = True
            elif w == "brand" and words:
                branded[-1] = True
            else:
                words.append(w)
                styled.append(pending)
                branded.append(False)
                pending = False
        line, place = " ", {}
        for i, w in enumerate(words):
            place[len(line) - 1] = i
            line += w + " "
        found = sorted(((-n, place[end + 1 - size], what, value) for end, (size, n, what, value) in self.auto.iter(line)), key=lambda x: x[:3]) if len(self.auto) else []
        taken, features, rest = set(), set(), []
        for n, i, what, value in found:
            span = range(i, i - n)
            if not taken.isdisjoint(span):
                continue
            if what == "maker":
                if "maker" in out:
                    continue  # a second maker is compared as other words
                self._take_maker(value, i, i - n, words, styled, taken, out)
            elif what == "feature":
                features.add(value)
            elif what != "praise" and out.setdefault(what, value) != value:
                rest.append(value)  # a second value is compared too
            taken.update(span)
        if "maker" not in out:
            self._unknown_maker(words, styled, branded, taken, out)
        if features:
            out["feature"] = ",".join(sorted(features))
        if "kind" not in out:
            free = {w: i for i, w in reversed(list(enumerate(words))) if i not in taken}
            # the words of a kind apart from each other, else side by side with a misspelling
            loose = min((x for w in free for x in self.by_word.get(w, ()) if x[0] <= free.keys()), key=lambda x: (-len(x[0]), x[1]), default=None)
            if loose:
                out["kind"] = loose[1]
                taken.update(free[w] for w in loose[0])
            else:
                self._misspelt(words, taken, out)
        left = [w for i, w in enumerate(words) if i not in taken and w != "|" and not (article and w == "a" and words[i + 1 : i + 2] == ["|"]) and w not in CUES and not self._idle(w, out.get("kind"))]
        rest += [w for w in left if was.get(w, w) == w or not self._meant(was[w], out.get("kind"))]
        if rest:
            out["rest"] = " ".join(sorted(rest))
        return out

    def _misspelt(self, words: list[str], taken: set[int], out: dict[str, str]) -> None:
        best = None
        for n in self.kind_sizes:
            for i in range(len(words) - n + 1):
                if taken.isdisjoint(range(i, i + n)):
                    text = " ".join(words[i : i + n])
                    for d, p in self.near_kinds.find(text, 2):
                        if d <= (1 if len(p) < 9 else 2) and p.count(" ") == n - 1 and (best is None or (d, p) < best[:2]):
                            best = (d, p, i, n)
        if best:
            out["kind"] = self.kinds[best[1]]
            taken.update(range(best[2], best[2] + best[3]))

    @staticmethod
    def _take_maker(value: tuple, i: int, j: int, words: list[str], styled: list[bool], taken: set[int], out: dict[str, str]) -> None:
        """Notes maker and model; a model not in the dictionary is what follows a word for model, or a letter or mix with digits."""
        maker, model = value
        out["maker"] = maker
        if model is None and j < len(words) and j not in taken and words[j] != "|" and (styled[j] or (len(words[j]) == 1 and words[j].isalpha()) or (re.search(r"\d", words[j]) and re.search(r"[a-z]", words[j]))):
            model = words[j]
            taken.add(j)
        if model:
            out["model"] = model

    def _unknown_maker(self, words: list[str], styled: list[bool], branded: list[bool], taken: set[int], out: dict[str, str]) -> None:
        """A name too rare for the dictionary: up to three words with a cue before, or "brand" or a model behind."""
        for j, w in enumerate(words):
            letter = len(w) == 1 and w.isalpha()
            if j in taken or w == "|" or not (styled[j] or letter):
                continue
            i = j
            while i > 0 and j - i < 3 and i - 1 not in taken and words[i - 1] not in CUES and words[i - 1] != "|" and words[i - 1] not in self.parts and any(c.isalpha() for c in words[i - 1]) and (i == j or len(words[i - 1]) > 1):
                i -= 1
            cue = i > 0 and words[i - 1] in CUES
            if i == j or not (cue or branded[j - 1] or styled[j]):
                continue
            if not cue:
                i = j - 1
            if len(words[j - 1]) < 3 and not cue:
                continue
            out["maker"], out["model"] = " ".join(words[i:j]), w
            taken.update(range(i, j + 1))
            return


#: A letter, digit or hidden digit.
_WORD = re.compile(r"[a-z0-9-]+|\|")


def _tokens(t: str) -> list[str]:
    """Words of letters and digits, and separators; a hyphen between letter and digit joins, other signs part."""
    return [w.translate(SHOW) for w in _WORD.findall(re.sub(r"(?<=[a-z])-(?=[0-9-])", "", t))]


@lru_cache(maxsize=2)
def reader(words: tuple, makers: tuple, kinds: tuple, models: tuple, praise: tuple, vocabulary: tuple) -> Reader:
    return Reader(words, makers, kinds, models, praise, {a: {v: list(ps) for v, ps in table} for a, table in vocabulary})


ATTRIBUTES = ("kind", "size", "pack", "material", "feature", "maker", "model", "rest")


def attributes(listings: DataFrame, key: str = "listing_id", text: str = "cleaned_description", category: str = "category", vocabulary: dict = VOCABULARY) -> DataFrame:
    """(<key>, kind, size, pack, material, feature, maker, model, rest): what each listing states, null where it doesn't.

    rest are the words that are none of the others. Null and blank descriptions state nothing. Repeated rows come out as
    often as they come in.
    """
    found = mine(listings, key, text, category, vocabulary)
    words = shields(found, vocabulary)
    terms = (words, tuple(found["makers"]), tuple(sorted(found["kinds"].items())), tuple(found["models"]), tuple(found["praise"]), tuple((a, tuple((v, tuple(ps)) for v, ps in t.items())) for a, t in vocabulary.items()))
    sent = listings.sparkSession.sparkContext.broadcast(terms)  # at most MAX_TERMS terms of each sort

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = reader(*sent.value)
        for f in frames:
            got = [r.read(t) if t else {} for t in f["__text"]]
            yield pd.DataFrame({key: f["__key"], **{a: [g.get(a) for g in got] for a in ATTRIBUTES}})

    kind = listings.schema[key].dataType.simpleString()
    return listings.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{a} string" for a in ATTRIBUTES))


def shields(found: dict, vocabulary: dict = VOCABULARY) -> tuple:
    """The right words that would be read as a misspelling of a dictionary's word if nobody knew them; the others need not be known."""
    means = {w for p in [*found["makers"], *found["kinds"], *found["praise"], *[p for t in vocabulary.values() for ps in t.values() for p in ps]] for w in p.split()} | PLAIN | set(CUES) | set(MODELS) | {"brand"}
    near = Near((w for w in means if len(w) > 2 and w.isalpha()), 2)
    return tuple(w for w in found["words"] if w not in means and near.find(w, 1 if len(w) < 7 else 2))


def grouped(read: DataFrame) -> DataFrame:
    """read with `product`, a hash of all attributes; what a listing doesn't state is equal to what another doesn't state.

    Only listings that state nothing at all belong to no product and are left out; unread() has them.
    """
    read = read.filter(F.coalesce(*ATTRIBUTES).isNotNull())
    return read.withColumn("product", F.unhex(F.sha2(F.to_json(F.struct(*ATTRIBUTES), {"ignoreNullFields": "false"}), 256)))


def unread(read: DataFrame) -> DataFrame:
    """The listings that state no kind or no maker, with what they do state; among them all that belong to no product."""
    return read.filter("kind is null or maker is null")
