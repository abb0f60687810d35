import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import canon_text as C


def canon(*texts):
    return C.canonical_column(pa.array(texts, pa.string())).to_pylist()


def test_forms_that_look_alike_agree():
    pairs = [("café", "café"), ("fiﬁﬃ", "fififfi"), ("ＴＥＳＴ（１）", "TEST(1)"), ("a b　c", "a b c"), ("pa​per­⁠s﻿", "papers"), ("сору", "copy"), ("Οο", "Oo"), ("5 µm", "5 μm"), ("K 4 ℃", "K 4 °C"), ("a‑b‐c", "a-b-c"), ("x\r\ny\rz", "x\ny\nz"), ("е́", "é"), ("й", "й"), ("ộ", "ộ"), ("각", "각")]
    for a, b in pairs:
        assert canon(a) == canon(b), (a, b)


def test_visible_differences_stay():
    for a, b in [("naïve", "naive"), ("Ab", "ab"), ("well-known", "wellknown"), ("10²", "102"), ("CO₂", "CO2"), ("a b", "ab"), ("a  b", "a b"), ("−", "-"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c"), ("a\nb", "a b"), ("ß", "β")]:
        assert canon(a) != canon(b), (a, b)
    assert canon("\U0001f469‍\U0001f52c") == ["\U0001f469‍\U0001f52c"]


def test_russian_words_keep_their_letters():
    assert canon("Молоко и paper", "лукk") == ["Молоко и paper", canon("лукk")[0]]


def test_nulls_empty_and_slices():
    col = pa.array(["a", None, "", "é", "​", "x" * 100_000 + "́"])
    assert C.canonical_column(col).to_pylist() == ["a", None, "", "é", "", "x" * 100_000 + "́"]
    assert C.canonical_column(col.slice(3, 2)).to_pylist() == ["é", ""]
    assert C.canonical_column(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), max_size=6))
def test_idempotent_and_row_local(texts):
    once = canon(*texts)
    assert canon(*once) == once
    assert once == [canon(t)[0] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeoucCdDzE\u0327\u0323\u0301\u0308\u0302\u00e9\u1ed9\u1100\u1161\u11a8\uac01\uac00 1"), max_size=14), max_size=5))
def test_composes_as_nfc(texts):
    assert canon(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_pairs(spark):
    rows = [(1, "copy paper"), (2, "сopy paper"), (3, "copy paper"), (4, "copy paper"), (5, None), (6, ""), (7, " "), (8, " "), (9, "Copy paper"), (10, "zz"), (11, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, C.look_alike_pairs(df, block=1).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert C.look_alike_pairs(df.limit(0)).count() == 0
    extra = C.canonical(df.selectExpr("text", "'x' as canonical", "doc_id")).collect()
    assert {r.doc_id: r.canonical for r in extra}[2] == "copy paper"


def test_large_shuffled_batch_matches_single_rows():
    random.seed(1)
    letters = "ab́̈‍сл ａﬁ\U0001f469\U0001f52c️\r\n"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 9))) for _ in range(3000)]
    assert canon(*texts) == [canon(t)[0] for t in texts]


def test_slices_change_nothing(monkeypatch):
    random.seed(2)
    texts = [None if random.random() < 0.1 else "".join(random.choice("ab\u0301\u0308\u0441 \uff41\ufb01\r\n") for _ in range(random.randint(0, 30))) for _ in range(1500)]
    whole = canon(*texts)
    for size in (7, 300, 9000):
        monkeypatch.setattr(C, "SLICE", size)
        assert canon(*texts) == whole
