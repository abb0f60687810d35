"""Byte-level BPE over a whole corpus, exact for texts of any length.

Texts up to `leaf` code points are encoded where they are read. A longer text is cut into leaves that are encoded as
separate rows by any executor; a tree of joins then concatenates neighbours. At each join the text around the seam is
encoded again in a window that grows until its pieces meet both neighbours' own pieces:

* The pre-tokenizer scans left to right and looks at most two characters past the end of a piece, so a piece of the left
  part that ends LOOK or more characters before the seam is final, and once the window's scan ends a piece where the right
  part's scan ends one too, both continue alike.
* Inside one huge piece (text without a break) token lists are joined instead. A list of tokens is the BPE encoding of
  its bytes exactly if every adjacent pair encodes to itself (van Antwerpen and Neubeck 2024, "So many tokens"), so the window
  of tokens around the seam grows until the pairs at both of its ends agree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.skew import salted_join
from tallyloom.runtime import materialize

#: Fixed value: the pre-tokenizer of the public byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK = 4
LEAF = 4096
FOLDER = "/opt/tokenizers"
EMPTY = np.zeros(0, np.uint32)


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    """Place of a rank file; the folder is a parameter or the setting TOKENIZERS_DIR."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", folder), f"{name}.tiktoken")


class Bpe:
    """One vocabulary in one worker process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.scan = regex.compile(PATTERN)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def piece(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data)

    def settled(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings of parts of one piece."""
        if not left or not right:
            return left + right
        k = 1
        if self.settled(left[-1], right[0]):
            return left + right
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self.piece(b"".join(self.bytes_of[t] for t in (*left[i:], *right[:j])))
            if (i == 0 or self.settled(left[i - 1], window[0])) and (j == len(right) or self.settled(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def long_piece(self, piece: str) -> list[int]:
        """A piece of any length: halves joined, as plain merging takes quadratic time."""
        if len(piece) <= LEAF:
            return self.piece(piece.encode())
        h = len(piece) // 2
        return self.join_tokens(self.long_piece(piece[:h]), self.long_piece(piece[h:]))

    def leaf(self, text: str) -> tuple[list[str], list[list[int]]]:
        """Pieces and their tokens."""
        pieces, out = self.scan.findall(text), []
        for p in pieces:  # words come again and again
            t = self.memo.get(p)
            if t is None:
                t = self.long_piece(p)
                if len(p) < 40 and len(self.memo) < 200_000:
                    self.memo[p] = t
            out.append(t)
        return pieces, out

    def join(self, left: tuple, right: tuple) -> tuple:
        """The pieces and tokens of the concatenated text."""
        (lp, lt), (rp, rt) = left, right
        if not lp or not rp:
            return (lp or rp), (lt or rt)
        i, tail = len(lp), 0  # pieces before i are final
        while i and (tail < LOOK or i == len(lp)):
            i -= 1
            tail += len(lp[i])
        head, n = "".join(lp[i:]), 0
        ends, taken, at = {}, 0, 0
        while True:
            while n < len(rp) and taken < max(LOOK, 2 * at):
                taken += len(rp[n])
                n += 1
                ends[len(head) + taken] = n
            at = taken
            window = head + "".join(rp[:n])
            last, pieces = n == len(rp), []
            for m in self.scan.finditer(window):
                pieces.append(m.group())
                e = m.end()
                if e >= len(head) and e in ends and (last or e + LOOK <= len(window)):
                    j = ends[e]
                    return lp[:i] + pieces + rp[j:], lt[:i] + [self._across(p, lp, lt, rp, rt) for p in pieces] + rt[j:]

    def _across(self, p: str, lp: list, lt: list, rp: list, rt: list) -> list[int]:
        if len(p) > LEAF and len(p) == len(lp[-1]) + len(rp[0]) and p.startswith(lp[-1]) and p.endswith(rp[0]):
            return self.join_tokens([int(t) for t in lt[-1]], [int(t) for t in rt[0]])
        return self.long_piece(p)

    def tree(self, parts: list[tuple]) -> tuple:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else ([], [])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode_batches(path: str, size_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            # token buffers go to Arrow as they are, without a Python object per token
            ids = [bpe.core.encode_to_numpy(t, disallowed_special=()) if t else EMPTY for t in b.column(b.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            if size_only:
                out = pa.array(sizes)
            else:
                flat = np.concatenate(ids).astype(np.int32) if ids else EMPTY.astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "ids"])

    return run


def _cut(leaf: int, at_once: int = 1024):
    """Texts to (__sha, __n, __part), their leaves, in one pass over each text and at_once leaves a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sha, text in zip(f["__sha"], f["__text"], strict=True):
                for at in range(0, len(text), leaf * at_once):
                    parts = [text[i : i + leaf] for i in range(at, min(at + leaf * at_once, len(text)), leaf)]
                    yield pd.DataFrame({"__sha": [sha] * len(parts), "__n": np.arange(len(parts), dtype=np.int32) + at // leaf, "__part": parts})

    return run


def encode(docs: DataFrame, text: str = "text", *, path: str | None = None, leaf: int = LEAF, size_only: bool = False) -> DataFrame:
    """docs with the column `text` replaced by `ids`: its token ids as an array of int (size_only: their number).

    Null and empty texts give the empty list (0); strings of special tokens are ordinary text. All other columns pass
    (but `ids`, which is replaced). Repeated rows stay rows of their own. Only texts above `leaf` code points are shuffled, in
    leaves; a group there is one distinct text, whose result is one row anyway.
    """
    path = path or vocabulary()
    keep = [c for c in docs.columns if c not in (text, "ids")]
    src = docs.select(*keep, F.col(text).alias("__text"))
    kind = T.IntegerType() if size_only else T.ArrayType(T.IntegerType())
    done = T.StructType([*[f for f in src.schema.fields if f.name != "__text"], T.StructField("ids", kind)])
    is_long = F.coalesce(F.length("__text"), F.lit(0)) > leaf
    short = src.filter(~is_long).mapInArrow(_encode_batches(path, size_only), done)

    # equal long texts are encoded once; a text is known by its SHA-256, which doesn't depend on where its row is read
    long = src.filter(is_long).withColumn("__sha", F.unhex(F.sha2("__text", 256)))
    parts = long.groupBy("__sha").agg(F.first("__text").alias("__text")).mapInPandas(_cut(leaf), "__sha binary, __n int, __part string")
    # by text and leaf number: every leaf of a long text may go to another task
    parts = parts.repartition("__sha", "__n")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for b in batches:
            got = [bpe.leaf(t) for t in b["__part"]]
            yield pd.DataFrame({"__sha": b["__sha"], "__n": b["__n"], "pieces": [p for p, _ in got], "tokens": [t for _, t in got]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        tokens = load(path).tree([(list(p), list(t)) for p, t in zip(pdf["pieces"], pdf["tokens"], strict=True)])[1]
        ids = np.concatenate([np.asarray(t, np.int32) for t in tokens]) if tokens else EMPTY
        return pd.DataFrame({"__sha": [pdf["__sha"].iloc[0]], "ids": [len(ids) if size_only else ids]})

    got = parts.mapInPandas(leaves, "__sha binary, __n int, pieces array<string>, tokens array<array<int>>").groupBy("__sha").applyInPandas(joined, T.StructType([T.StructField("__sha", T.BinaryType()), T.StructField("ids", kind)]))
    sizes = materialize(long.groupBy("__sha").agg(F.count("*").alias("__many")), "sizes")
    back = salted_join(long.drop("__text").withColumn("__spread", F.monotonically_increasing_id()), got, ["__sha"], size="__many", spread_by=["__spread"], sizes=sizes)
    return short.unionByName(back.drop("__sha", "__spread"))
