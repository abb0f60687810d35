"""One form for text that looks the same: widths, accents, ligatures, look-alike letters, spaces, invisible signs.

A whole Arrow column becomes one numpy array of code points; lookup tables say what every code point expands to, gathers
and running offsets apply them, and marks are ordered and composed by sorted-key search. No call is made per row.

What stays different is what a reader sees: accents, letter case, raised and lowered digits, hyphen or none, the number
of spaces, line breaks, joined and unjoined emoji.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like a Latin letter, and that letter.
CYRILLIC = dict(zip("аеоѕіјрсхуһԛԝѵАВЕЅІЈКМНОРСТУХҮԚԜ", "aeosijpcxyhqwvABESIJKMHOPCTYXYQW", strict=True))
GREEK = dict(zip("οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ocjABEZHIKMNOPTYXCJ", strict=True))
# Other signs drawn alike.
SIGNS = {"‐": "-", "‑": "-", "µ": "μ", "∆": "Δ", "℃": "°C", "℉": "°F", "ı̇": "i", "․": ".", "∙": "·", "⋅": "·", "⁄": "/", "∕": "/"}
# Code points whose compatibility form shows the same letters (ligatures, digraphs, number letters).
SAME_LETTERS = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Signs without any appearance of their own, but for joiners and variation selectors.
INVISIBLE = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE007F))
JOINERS, SELECTORS = (0x200C, 0x200D), ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# Where joiners and selectors show: pictures, and scripts whose letters join.
PICTURES = ((0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x24C2, 0x24C2), (0x25A0, 0x27BF), (0x2900, 0x297F), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF))
JOINING = ((0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0x109F), (0x1780, 0x18AF), (0xA840, 0xA87F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))
TOP = 0x110000
SLICE = 4 << 20


def _ranges(pairs) -> np.ndarray:
    out = np.zeros(TOP, bool)
    for a, b in pairs:
        out[a : b + 1] = True
    return out


class Tables:
    """Built once in a worker from unicodedata and the fixed values above."""

    def __init__(self):
        alike = CYRILLIC | GREEK
        same = _ranges(SAME_LETTERS)
        self.gone, self.picture, self.joining = _ranges(INVISIBLE), _ranges(PICTURES), _ranges(JOINING)
        self.joiner, self.selector = _ranges([(x, x) for x in JOINERS]), _ranges(SELECTORS)
        self.length = np.ones(TOP, np.uint8)
        self.start = np.arange(TOP, dtype=np.int32)  # into flat: the code point itself
        self.ccc = np.zeros(TOP, np.uint8)
        self.second = np.zeros(TOP, bool)  # may compose with what stands before it
        extra: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(TOP):
            if 0xD800 <= cp <= 0xDFFF or 0xF0000 <= cp:
                continue
            ch = chr(cp)
            how = unicodedata.decomposition(ch)
            self.ccc[cp] = unicodedata.combining(ch)
            if unicodedata.category(ch) == "Zs":
                to = " "
            elif ch in SIGNS:
                to = SIGNS[ch]
            elif how.startswith(("<wide>", "<narrow>")) or (how and same[cp]):
                to = unicodedata.normalize("NFKD", ch)
            elif 0xAC00 <= cp <= 0xD7A3 or (how and how[0] != "<"):
                to = unicodedata.normalize("NFD", ch)
            else:
                to = ch
            if how and how[0] != "<" and " " in how or 0xAC00 <= cp <= 0xD7A3:
                a = unicodedata.normalize("NFD", ch)
                head = unicodedata.normalize("NFC", a[:-1])
                if len(head) == 1 and unicodedata.normalize("NFC", a) == ch:
                    pairs[ord(head), ord(a[-1])] = cp
            to = "".join(alike.get(c, c) for c in to)
            if to != ch:
                self.length[cp] = len(to)
                self.start[cp] = TOP + len(extra)
                extra.extend(map(ord, to))
        self.flat = np.concatenate([np.arange(TOP, dtype=np.uint32), np.array(extra, np.uint32)])
        keys = np.array([(a << 21) | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        for _, b in pairs:
            self.second[b] = True
        # 1: Latin letter with a Cyrillic twin, 2: letter only Cyrillic has, 3: letter only Latin has, 4: goes with a word
        self.script = np.zeros(TOP, np.uint8)
        self.twin = np.arange(TOP, dtype=np.uint32)
        for cp in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)):
            self.script[cp] = 3
        for cp in range(0x400, 0x530):
            self.script[cp] = 2
        for c, lat in reversed(CYRILLIC.items()):
            self.script[ord(lat)] = 1
            self.twin[ord(lat)] = ord(c)
        self.script[self.ccc > 0] = 4


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _compose(t: Tables, cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    while True:
        at = np.flatnonzero(t.second[cps])
        at = at[at > 0]
        if not len(at):
            return cps, row
        ccc = t.ccc[cps]
        start = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cps)), -1))
        base = start[at - 1]  # the starter before it
        ok = (base >= 0) & (row[np.maximum(base, 0)] == row[at])
        ok &= np.where(ccc[at] == 0, base == at - 1, (base == at - 1) | (ccc[at - 1] < ccc[at]))
        at, base = at[ok], base[ok]
        key = (cps[base].astype(np.uint64) << np.uint64(21)) | cps[at].astype(np.uint64)
        i = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        hit = t.keys[i] == key
        at, base, i = at[hit], base[hit], i[hit]
        if not len(at):
            return cps, row
        # one mark a base and pass, and no base that is itself taken in this pass
        first = np.unique(base, return_index=True)[1]
        at, base, i = at[first], base[first], i[first]
        free = ~np.isin(base, at)
        at, base, i = at[free], base[free], i[free]
        cps = cps.copy()
        cps[base] = t.made[i]
        keep = np.ones(len(cps), bool)
        keep[at] = False
        cps, row = cps[keep], row[keep]


def canonical_column(col: pa.Array) -> pa.Array:
    """The canonical form of every text; null stays null, empty stays empty.

    Works through slices of about SLICE bytes, as the arrays take some forty times the text; a longer text is a slice.
    """
    col = pa.concat_arrays([col]).cast(pa.string()) if col.offset else col.cast(pa.string())
    ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1)[1:].astype(np.int64) if len(col) else np.zeros(0, np.int64)
    if not len(col) or ends[-1] <= SLICE:
        return _canonical_slice(col)
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // SLICE, prepend=0)) , [len(col)]]))
    return pa.concat_arrays([_canonical_slice(pa.concat_arrays([col.slice(a, b - a)])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _canonical_slice(col: pa.Array) -> pa.Array:
    t = tables()
    n = len(col)
    valid, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32, n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if not len(raw):
        return col
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(chars))

    keep = ~t.gone[cps]
    cps, row = cps[keep], row[keep]
    # line ends: a lone or paired carriage return is one line feed
    cr = np.flatnonzero(cps == 13)
    if len(cr):
        nxt = np.minimum(cr + 1, len(cps) - 1)
        paired = (cps[nxt] == 10) & (row[nxt] == row[cr]) & (nxt != cr)
        cps = cps.copy()
        cps[cr[~paired]] = 10
        keep = np.ones(len(cps), bool)
        keep[cr[paired]] = False
        cps, row = cps[keep], row[keep]
    # joiners and selectors stay only where they show
    at = np.flatnonzero(t.joiner[cps] | t.selector[cps])
    if len(at):
        m = len(cps)
        prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 1, m - 1)
        inside = (prev != at) & (row[prev] == row[at])
        after = (nxt != at) & (row[nxt] == row[at])
        back = np.where(t.selector[cps[prev]], np.maximum(prev - 1, 0), prev)
        shows = np.where(
            t.selector[cps[at]],
            inside & t.picture[cps[prev]],
            inside & after & ((t.picture[cps[back]] & (row[back] == row[at]) & t.picture[cps[nxt]] & (cps[at] == 0x200D)) | (t.joining[cps[prev]] & t.joining[cps[nxt]])),
        )
        keep = np.ones(m, bool)
        keep[at[~shows]] = False
        cps, row = cps[keep], row[keep]
    # expansion: each code point's run in the flat table
    size = t.length[cps].astype(np.int64)
    if (size != 1).any() or (t.start[cps] != cps).any():
        ends = np.cumsum(size)
        first = np.repeat(t.start[cps].astype(np.int64) - (ends - size), size)
        cps, row = t.flat[first + np.arange(ends[-1] if len(ends) else 0)], np.repeat(row, size)
    # canonical order of marks
    ccc = t.ccc[cps]
    marks = np.flatnonzero(ccc > 0)
    if len(marks) > 1:
        group = np.cumsum((ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
        cps = cps.copy()
        cps[marks] = cps[marks[np.lexsort((ccc[marks], group[marks]))]]
    # words that only Cyrillic can write get their own letters back
    kind = t.script[cps]
    if (kind == 2).any():
        new = np.concatenate([[True], (row[1:] != row[:-1]) | ((kind[1:] == 0) != (kind[:-1] == 0))])
        word = np.cumsum(new) - 1
        cyr = np.bincount(word, kind == 2) > 0
        lat = np.bincount(word, kind == 3) > 0
        turn = (cyr & ~lat)[word] & (kind == 1)
        cps = np.where(turn, t.twin[cps], cps).astype(np.uint32)
    cps, row = _compose(t, cps, row)

    out = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.cumsum(np.bincount(row, width, minlength=n)) if len(cps) else np.zeros(n)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out), valid if col.null_count else None, col.null_count)


def canonical(df: DataFrame, text: str = "text", into: str = "canonical") -> DataFrame:
    """df with the column `into`, the canonical form of `text` (an existing column of that name is replaced)."""
    src = df.drop(into) if into != text else df
    schema = T.StructType([*[f for f in src.schema.fields if f.name != into], T.StructField(into, T.StringType())])
    names = [f.name for f in schema.fields]
    where = src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = canonical_column(b.column(where))
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(b.columns, b.schema.names, strict=True) if n != into], made], names=names)

    return src.mapInArrow(run, schema)


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", *, block: int = 4096) -> DataFrame:
    """(<key>_a, <key>_b): each pair of rows with different stored texts of the same canonical form, smaller key first.

    Null texts and texts without anything visible pair with nothing. Forms and stored texts are compared by their SHA-256.
    Only rows of different stored texts of one form meet, in blocks, so the work is the number of pairs, which are the result.
    """
    from tallyloom.operators.skew import pairs_across
    from tallyloom.runtime import materialize

    sha = lambda c: F.unhex(F.sha2(c, 256))
    src = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    rows = canonical(src).filter(F.col("canonical").rlike(r"[^\s\p{Z}\p{C}]")).select("id", sha(F.col("canonical")).alias("form"), sha(F.col("text")).alias("stored"))
    rows = materialize(rows, "forms")
    return pairs_across(rows.withColumnRenamed("id", key), ["form"], key, "stored", block=block)
