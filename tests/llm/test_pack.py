import random

import numpy as np
import pytest

from tallyloom.llm import pack


def check(rows, capacity, segments, loss_capacity):
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    for members in by.values():
        assert sum(m.n_tokens for m in members) <= capacity
        assert len(members) <= segments
        assert sum(m.loss_tokens for m in members) <= loss_capacity
        assert sorted(m.segment for m in members) == list(range(len(members)))
    return by


def test_block_respects_three_limits():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 200, 3000)
    loss = np.minimum((t * rng.random(3000)).astype(int), 90)
    got = pack.pack_block(t, loss, capacity=256, segments=6, loss_capacity=90)
    assert sorted(i for m in got for i in m) == list(range(3000))
    for m in got:
        assert t[m].sum() <= 256 and len(m) <= 6 and loss[m].sum() <= 90
    need = max(t.sum() / 256, 3000 / 6, loss.sum() / 90)
    assert len(got) < 1.25 * need


def test_pack_covers_every_token_once(spark):
    random.seed(2)
    rows = [(i, random.choice([0, 3, 50, 700, 2048, 2049, 9000]) if i % 7 else None, "c") for i in range(900)] + [(5, 10, "again"), (5, 10, "again")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, segment string").repartition(3)
    got = pack.pack(df).collect()
    by = check(got, 2048, 256, 2048)
    ranges = {}
    for r in got:
        ranges.setdefault(r.doc_id, []).append((r.token_start, r.token_start + r.n_tokens))
    for i, n, _ in rows[:900]:
        if i == 5:
            continue
        at = 0
        for a, b in sorted(ranges[i]):
            assert a == at
            at = b
        assert at == (n or 0) and len(ranges[i]) == max(1, -(-(n or 0) // 2048))
    assert len(got) >= 902
    total = sum(r.n_tokens for r in got)
    assert sum(1 for m in by.values() if sum(x.n_tokens for x in m)) <= 1.05 * total / 2048 + 3


def test_pack_empty_and_bad_limits(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert pack.pack(df).count() == 0
    with pytest.raises(ValueError):
        pack.pack(df, capacity=0)


def test_loss_column_limits(spark):
    df = spark.createDataFrame([(i, 100, 60 if i % 2 else None) for i in range(200)], "doc_id long, n_tokens int, loss int")
    got = pack.pack(df, capacity=1000, segments=8, loss="loss", loss_capacity=300).collect()
    check(got, 1000, 8, 300)
    assert sum(r.loss_tokens for r in got) == 100 * 60


def test_documents_fill(spark):
    from tallyloom.llm.queries_tokens import p7_containers

    got = p7_containers(spark, "/root/testdata/sf0.01").collect()
    by = check(got, 2048, 256, 2048)
    assert sum(r.n_tokens for r in got) > 0.95 * 2048 * len(by)


@pytest.mark.parametrize("final", [False, True])
def test_items_that_fill_nothing_are_not_held(monkeypatch, final):
    import pandas as pd

    monkeypatch.setattr(pack.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    sizes, real = [], pack.pack_block
    monkeypatch.setattr(pack, "pack_block", lambda tokens, *a, **k: (sizes.append(len(tokens)), real(tokens, *a, **k))[1])
    frames = (pd.DataFrame({"n_tokens": np.full(100, 1500), "loss_tokens": np.full(100, 9), "at": np.arange(100) + 100 * i}) for i in range(40))
    out = pd.concat(list(pack._packer(2048, 256, 2048, 100, final)(frames)))
    assert sorted(out["at"]) == list(range(4000)) and max(sizes) <= 300
    assert out["container_id"].nunique() == (4000 if final else 1)


def test_masked_documents(spark):
    from tallyloom.llm.queries_tokens import p7_masked

    d = "/root/testdata/sf0.001"
    rows = p7_masked(spark, d).collect()
    by = check(rows, 2048, 8, 1400)
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert any(len(m) == 8 for m in by.values()) and any(sum(x.loss_tokens for x in m) > 1390 for m in by.values())
