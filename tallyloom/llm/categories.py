"""Mapping freely typed values to a reference list.

First an Aho-Corasick automaton over the canonical names and their aliases finds mentions inside the typed value; of those
that begin and end on word borders the longest wins, the first of equals (any other would overlap it or name a second
entry). What is left goes to token-set similarity: each
word of a name looks for its best counterpart among the typed words (equal, cut short, without vowels, or misspelt by a few
edits), rare words of the list weighing more than common ones. Values that reach no entry are reported with id 0.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.spelling import Near, edits

# Words and phrases for the same thing; each is also tried in place of the other in the names.
SYNONYMS = [
    ("coverslips", "cover glasses"), ("waste disposal", "waste removal"), ("wipes", "tissues"), ("fibre", "fiber"), ("labelled", "labeled"), ("colorimetric", "colourimetric"),
    ("licence", "license"), ("fridge", "refrigerator"), ("mail", "post"), ("laptop", "notebook computer"), ("drive", "disk"), ("monitor", "screen"), ("beaker", "measuring cup"),
    ("pcr", "thermal cycler"), ("bags", "sacks"), ("goggles", "safety glasses"), ("freezer", "deep freeze"), ("charge", "fee"), ("pickup", "collection"), ("needles", "syringe needles"),
    ("antibody", "ab"), ("supplies", "materials"), ("markers", "pens"), ("adhesive tape", "sticky tape"), ("sutures", "stitches"), ("mix", "mixture"), ("medium", "media"),
]
# Order-note words that say nothing about the category.
NOISE = frozenset("a an and at by etc for from in item lab misc new of old code on order per re reorder restock rm room s the to with".split())
ACCEPT, LEAST_WORD, EXTRA = 0.64, 0.42, 0.17
MAX_NAMES = 100_000
VOWELS = re.compile(r"(?<=.)[aeiou]")


def words(value: str) -> list[str]:
    """Lower-case ASCII words; accents are dropped, anything else separates."""
    flat = unicodedata.normalize("NFKD", value)
    return re.findall(r"[a-z0-9]+", "".join(c for c in flat.lower() if not unicodedata.combining(c)))


def stem(w: str) -> str:
    """Singular of a plural."""
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith(("ses", "xes", "shes", "ches", "zes")):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def letters(w: str) -> int:
    m = 0
    for c in w:
        m |= 1 << (ord(c) % 63)
    return m


class Matcher:
    """The list, compiled once in each worker."""

    def __init__(self, names: list[tuple[int, str]], synonyms: tuple = tuple(SYNONYMS)):
        self.synonyms = synonyms
        self.ids = [i for i, _ in names]
        self.auto = ahocorasick.Automaton()
        seen: dict[str, set[int]] = {}
        forms: list[tuple[int, list[str]]] = []
        raw: dict[str, str] = {}
        for k, (_, name) in enumerate(names):
            for n in self._aliases(name):
                full = words(n)
                w = [stem(x) for x in full]
                if not w:
                    continue
                forms.append((k, w))
                raw |= dict(zip(w, full, strict=True))
                for r in range(len(w)):
                    seen.setdefault("".join(w[r:] + w[:r]), set()).add(k)
                    seen.setdefault("".join(full[r:] + full[:r]), set()).add(k)
        for text, ks in seen.items():
            if len(ks) == 1 and len(text) > 3:  # a form of two entries tells nothing
                self.auto.add_word(text, (len(text), next(iter(ks))))
        if len(self.auto):
            self.auto.make_automaton()
        self.vocab = sorted({w for _, f in forms for w in f})
        at = {w: i for i, w in enumerate(self.vocab)}
        self.raw = [raw[w] for w in self.vocab]
        self.bare = [VOWELS.sub("", w) for w in self.vocab]
        self.mask = [letters(w) for w in self.vocab]
        df = Counter(w for _, f in {(k, tuple(sorted(set(f)))) for k, f in forms} for w in f)
        n = max(1, len(names))
        width = max((len(f) for _, f in forms), default=1)
        self.of = np.array([k for k, _ in forms], int)
        self.index = np.zeros((len(forms), width), int)
        self.weight = np.zeros((len(forms), width))
        for r, (_, f) in enumerate(forms):
            for c, w in enumerate(f):
                self.index[r, c] = at[w]
                self.weight[r, c] = 1 + np.log(n / min(n, df[w]))
        self.at = at
        self.postings: list[list[int]] = [[] for _ in self.vocab]
        for r, (_, f) in enumerate(forms):
            for w in f:
                self.postings[at[w]].append(r)
        self.lengths = np.array([len(f) for _, f in forms], int)
        self.by_bare = sorted((b, i) for i, b in enumerate(self.bare))
        self.by_raw = sorted((w, i) for i, w in enumerate(self.raw))
        # plurals are looked up under both forms, so both are indexed
        self.near = Near({*self.vocab, *self.raw}, 3, prefix=7)
        self.places: dict[str, set[int]] = {}
        for i, v in enumerate(self.vocab):
            self.places.setdefault(v, set()).add(i)
            self.places.setdefault(self.raw[i], set()).add(i)
        self.masks, self.sizes = np.array(self.mask, np.int64), np.array([len(v) for v in self.vocab], np.int64)
        self.whole: dict[str, list[int]] = {}
        for r, (_, f) in enumerate(forms):
            for x in {"".join(f), "".join(f[-1:] + f[:-1])}:
                self.whole.setdefault(x, []).append(r)
        self.near_whole = Near((x for x in self.whole if len(x) <= 40), 3, prefix=7)
        self.long_whole = [x for x in self.whole if len(x) > 40]
        self._near = lru_cache(maxsize=200_000)(self._near_uncached)
        self.match = lru_cache(maxsize=200_000)(self._match)

    def _aliases(self, name: str) -> set[str]:
        out = {name}
        for a, b in self.synonyms:
            for x, y in ((a, b), (b, a)):
                if re.search(rf"(?<![a-z]){x}(?![a-z])", name.lower()):
                    out.add(re.sub(rf"(?<![a-z]){x}(?![a-z])", y, name.lower()))
        if "labelled" in name.lower():
            out.add(name.lower().replace("labelled", "labeled"))
        return out

    def _candidates(self, w: str, s: str) -> list[int]:
        """The words of the list that can be like a typed word: equal, begun by it, without vowels, or a few edits away."""
        found = {i for t in (s, w) if t in self.places for i in self.places[t]}
        for t in {s, w} if len(w) >= 2 else ():
            at = bisect_left(self.vocab, t)
            while at < len(self.vocab) and self.vocab[at].startswith(t):
                found.add(at)
                at += 1
        for t in {s, w, w[:-1] if w.endswith("s") else w}:
            at = bisect_left(self.by_bare, (t, -1))
            while at < len(self.by_bare) and self.by_bare[at][0].startswith(t):
                found.add(self.by_bare[at][1])
                at += 1
        for t in {s, w}:
            found.update(i for k in self.near.maybe(t) for i in self.places[self.near.words[k]])
        if s != w and len(s) >= 3:  # a misspelt beginning
            found.update(np.nonzero((self.sizes > len(s) + 1) & (np.bitwise_count(self.masks ^ letters(s)) <= 8))[0].tolist())
        return sorted(found)

    def _near_uncached(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words of the list that a typed word is like, how like)."""
        s = stem(w)
        m, bare, got = letters(s), VOWELS.sub("", s), []
        for i in self._candidates(w, s):
            v = self.vocab[i]
            if v == s or v == w:
                got.append((i, 1.0))
                continue
            best = 0.0
            if len(s) < len(v):
                if len(w) >= 2 and (v.startswith(s) or v.startswith(w)):
                    best = 0.78 + 0.2 * len(s) / len(v) if len(s) > 2 else 0.6
                elif s[0] == v[0] and len(s) >= 2 and (s == self.bare[i] or w == self.bare[i] or w == self.bare[i] + "s"):
                    best = 0.9
                elif s[0] == v[0] and len(s) >= 4 and bare == s and self.bare[i].startswith(s):
                    best = 0.75
            most = 1 if len(v) <= 3 else 2 if len(v) <= 8 else 3
            if best < 0.9 and min(len(v), len(s)) >= 2 and bin(m ^ self.mask[i]).count("1") <= 2 * most + 2:
                d = min(edits(s, v, most), edits(w, self.raw[i], most) if (w, self.raw[i]) != (s, v) else most + 1)
                if d <= most:
                    best = max(best, 1 - d / max(len(v), 3) * 0.9)
                if len(s) >= 3 and len(v) > len(s) + 1 and s != w and edits(s, v[: len(s)], 1) <= 1 and best < 0.5:
                    best = max(best, 0.5)
            if best > 0:
                got.append((i, best))
        return np.array([i for i, _ in got], int), np.array([x for _, x in got])

    def _match(self, value: str) -> tuple[int, str, float]:
        """(id or 0, 'mention', 'similar' or 'none', score)."""
        typed = words(value)
        hit = min((h for h in (self._mention(typed), self._mention([stem(w) for w in typed])) if h), default=None)
        if hit:
            return self.ids[hit[1]], "mention", 1.0
        content = list(dict.fromkeys(w for w in typed if w in self.at or not any(c.isdigit() for c in w)))
        telling = np.array([w not in NOISE for w in content], bool)
        if not telling.any() or not len(self.of):
            return 0, "none", 0.0
        near = [self._near(w) for w in content]
        like = {}
        for at, x in near:
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                like[i] = max(like.get(i, 0.0), v)
        # only names each word of which has a counterpart can be meant
        forms, n = np.unique(np.array([r for i, v in like.items() if v >= LEAST_WORD for r in self.postings[i]], int), return_counts=True)
        forms = forms[n == self.lengths[forms]]
        top, who = 0.0, int(self.of[0])
        if len(forms):
            here, position = np.unique(self.index[forms], return_inverse=True)
            index, weight = position.reshape(len(forms), -1), self.weight[forms]
            s = np.zeros((len(content), len(here)))
            for t, (at, x) in enumerate(near):
                k = np.searchsorted(here, at)
                ok = (k < len(here)) & (here[np.minimum(k, len(here) - 1)] == at)
                s[t, k[ok]] = x[ok]
            per = np.where(weight > 0, s.max(axis=0)[index], 1.0)
            score = (per * weight).sum(axis=1) / weight.sum(axis=1)
            covered = np.stack([np.where(weight > 0, s[t][index], 0).max(axis=1) for t in range(len(content))])
            score = score - EXTRA * (covered[telling] < LEAST_WORD).sum(axis=0)
            best = int(np.argmax(score))
            top, who = max(float(score[best]), 0.0), int(self.of[forms[best]])
        if top < ACCEPT:
            r, like = self._as_one("".join(stem(w) for w in content if w not in NOISE or w in self.at))
            if like > max(top, ACCEPT):
                top, who = like, int(self.of[r])
        return (self.ids[who], "similar", top) if top >= ACCEPT else (0, "none", max(top, 0.0))

    def _mention(self, typed: list[str]) -> tuple[int, int] | None:
        """(minus the length, entry) of the longest mention that begins and ends on word borders; the first of equals."""
        text, starts, at = "".join(typed), set(), 0
        for w in typed:
            starts.add(at)
            at += len(w)
        if not text or not len(self.auto):
            return None
        found = sorted((-size, end + 1 - size, k) for end, (size, k) in self.auto.iter(text) if end + 1 - size in starts and end + 1 in (starts | {at}))
        return (found[0][0], found[0][2]) if found else None

    def _as_one(self, text: str) -> tuple[int, float]:
        """Likeness with lost or misplaced spaces: the whole value against whole names."""
        best, row = 0.0, 0
        m = letters(text)
        found = [self.near_whole.words[k] for k in self.near_whole.maybe(text)] + [x for x in self.long_whole if abs(len(x) - len(text)) <= 3]
        for x in sorted(found, key=lambda x: (len(x), self.whole[x][0])):
            most = min(3, len(x) // 5)
            if abs(len(x) - len(text)) > 3 or bin(m ^ letters(x)).count("1") > 2 * most:
                continue
            d = edits(text, x, most)
            if d <= most and 1 - d / len(x) > best:
                best, row = 1 - d / len(x), self.whole[x][0]
        return row, best


@lru_cache(maxsize=2)
def matcher(names: tuple, synonyms: tuple = tuple(SYNONYMS)) -> Matcher:
    return Matcher(list(names), synonyms)


def reference(categories: DataFrame, key: str = "category_id", name: str = "category") -> tuple:
    """The list on the driver. It is a reference list: above MAX_NAMES entries this refuses rather than broadcast it."""
    rows = categories.select(key, name).filter(F.col(name).isNotNull()).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the reference list has more than {MAX_NAMES} entries")
    return tuple(sorted((r[0], r[1]) for r in rows))


def map_values(rows: DataFrame, categories: DataFrame, key: str = "entry_id", value: str = "category", *, synonyms: Iterable[tuple[str, str]] = tuple(SYNONYMS)) -> DataFrame:
    """(<key>, <value>, category_id, how, score) of every row.

    how: 'exact' (the value is an entry), 'mention', 'similar', 'none' (id 0: the list has no such entry) or 'blank' (id
    null: null, or no letter or digit). Ties go to the smaller id. No shuffle: rows are mapped where they are read, equal values of
    a batch once, and each worker keeps the last 200,000 different values. An empty list maps everything to 0. synonyms: pairs
    of words or phrases that name the same; aliases of an entry are its name with one put for the other.
    """
    names = reference(categories)
    exact, pairs = {n: i for i, n in names}, tuple(synonyms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = matcher(names, pairs)
        for f in frames:
            got = {}
            for v in f["__value"].unique():
                if v is None or not any(c.isalnum() for c in v):
                    got[v] = (None, "blank", 0.0)
                elif v in exact:
                    got[v] = (exact[v], "exact", 1.0)
                else:
                    got[v] = m.match(v)
            hits = [got[v] for v in f["__value"]]
            yield pd.DataFrame({key: f["__key"], value: f["__value"], "category_id": pd.array([h[0] for h in hits], dtype="Int64"), "how": [h[1] for h in hits], "score": [h[2] for h in hits]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("__key"), F.col(value).alias("__value")).mapInPandas(run, f"`{key}` {kind}, `{value}` string, category_id bigint, how string, score double")


def unmatched(mapped: DataFrame, value: str = "category") -> DataFrame:
    """(<value>, n): the typed values without an entry and how often each occurs."""
    return mapped.filter("how = 'none'").groupBy(value).agg(F.count("*").alias("n"))


def evaluate(values: Iterable[str], names: tuple) -> dict[str, tuple[int, str, float]]:
    """The match of each value, for tests and inspection."""
    m = matcher(names)
    return {v: m.match(v) for v in values}
