import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import tokenize as T


@pytest.fixture(scope="module")
def bpe():
    return T.load(T.vocabulary())


def test_tree_equals_plain_encoding(bpe, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(T, "LEAF", 6)
    letters = "ab  \n\t'sltre1.,<|endoftext|>éж漢👩‍🔬 "
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 70))) if random.random() < 0.7 else random.choice("a 漢x.") * random.randint(1, 90)
        leaf = random.randint(1, 9)
        ids = [i for t in bpe.tree([bpe.leaf(text[i : i + leaf]) for i in range(0, len(text), leaf)])[1] for i in t]
        assert ids == bpe.encode(text), text


def test_huge_piece_without_breaks(bpe):
    random.seed(6)
    text = "".join(random.choice("abcdefghinorst") for _ in range(60_000))
    assert [i for t in bpe.tree([bpe.leaf(text[i : i + 4096]) for i in range(0, len(text), 4096)])[1] for i in t] == bpe.encode(text)


def test_encode_defined_cases(spark, bpe):
    long = "x y'll 12 " * 2000
    rows = [(1, None, "u"), (2, "", "u"), (3, "<|endoftext|> a", "u"), (4, long, "u"), (4, long, "v"), (5, "漢" * 9000, "w"), (5, "short", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("pieces", F.lit(1))
    got = sorted((r.doc_id, r.pieces, tuple(r.ids)) for r in T.encode(df).collect())
    assert got == sorted((i, 1, tuple(bpe.encode(t or ""))) for i, t, _ in rows)
    assert sorted((r.doc_id, r.ids) for r in T.encode(df, size_only=True).collect()) == sorted((i, len(bpe.encode(t or ""))) for i, t, _ in rows)
    assert T.encode(df.limit(0)).count() == 0


def test_round_trip_of_a_table(spark, bpe):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in T.encode(docs, leaf=100).join(docs, "doc_id").collect():
        assert b"".join(bpe.bytes_of[i] for i in r.ids).decode() == (r.text or "")
        assert r.ids == bpe.encode(r.text or "")
