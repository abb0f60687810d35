"""Packing texts into containers of fixed capacity: vector bin packing by the dot-product heuristic.

An item has three sizes: its tokens, one segment, and its loss-bearing tokens. An open container takes, among the items
that fit in all three, the one with the largest weighted dot product of its sizes and what is left of the container
(Panigrahy et al. 2011); each dimension weighs as the share of its limit that the average item takes. Items of equal
sizes are one class, so a step looks at classes, not items.

Each task packs its own rows in blocks, without a shuffle. Containers of a block that are not full to FULL are opened
again: their items go into the next block, at most HELD blocks of rows of them; what exceeds that, and what the last block of a task
leaves, goes, GATHER items together and mixed, into a second and last round, which closes its fullest containers where
the first would send items on. So a task holds a bounded number of rows and its time is linear in them, even if the items of
the table fill no container, and only one task for every GATHER such items leaves containers with room.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialize

CAPACITY = 2048
SEGMENTS = 256
BLOCK = 8192
FULL = 0.995
HELD = 1
GATHER = 200_000


def pack_block(tokens: np.ndarray, loss: np.ndarray, *, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None) -> list[list[int]]:
    """Containers as lists of item numbers. Every item must fit alone; ties take the earlier class, then the earlier item."""
    if not len(tokens):
        return []
    caps = np.array([capacity, segments, capacity if loss_capacity is None else loss_capacity], dtype=np.float64)
    sizes = np.stack([tokens, np.ones(len(tokens)), loss], axis=1).astype(np.float64) / caps
    kinds, which = np.unique(np.stack([-tokens, -loss], axis=1), axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    first = np.concatenate([[0], np.cumsum(left)[:-1]])
    vec = np.stack([-kinds[:, 0] / caps[0], np.full(len(kinds), 1 / caps[1]), -kinds[:, 1] / caps[2]], axis=1)
    weight = sizes.mean(axis=0)
    out = []
    live = np.arange(len(kinds))
    while len(live):
        room, members = np.ones(3), []
        while True:
            fits = live[(vec[live] <= room + 1e-12).all(axis=1) & (left[live] > 0)]
            if not len(fits):
                break
            best = fits[np.argmax(vec[fits] @ (weight * room))]
            members.append(int(order[first[best]]))
            first[best] += 1
            left[best] -= 1
            room = room - vec[best]
        if not members:
            raise ValueError("an item is larger than a container")
        out.append(members)
        live = live[left[live] > 0]
    return out


def _packer(capacity: int, segments: int, loss_capacity: int, block: int, final: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        held: pd.DataFrame | None = None
        pending: list[pd.DataFrame] = []
        waiting = 0

        def flush(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            """(rows with a container or -1 for the second round, rows to hold)."""
            nonlocal n
            tokens, loss = rows["n_tokens"].to_numpy(np.int64), rows["loss_tokens"].to_numpy(np.int64)
            number = np.full(len(rows), -1, np.int64)
            place = np.zeros(len(rows), np.int32)
            most, left = 0 if last else HELD * block, len(rows)
            full = lambda m: max(tokens[m].sum() / capacity, len(m) / segments, loss[m].sum() / loss_capacity)
            packed = [(full(m), m) for m in pack_block(tokens, loss, capacity=capacity, segments=segments, loss_capacity=loss_capacity)]
            for used, members in sorted(packed, key=lambda x: -x[0]):
                if used >= FULL or (final and left > most):
                    number[members] = (int(final) << 62) + (part << 33) + n
                    place[members] = np.arange(len(members))
                    n += 1
                    left -= len(members)
            go = number >= 0
            if left > most:  # the first of the others make room
                go[np.flatnonzero(~go)[: left - most]] = True
            return rows[go].assign(container_id=number[go], segment=np.where(number[go] < 0, -1, place[go]).astype(np.int32)), rows[~go]

        for f in frames:
            pending.append(f)
            waiting += len(f)
            if waiting >= block:
                rows = pd.concat([*([held] if held is not None else []), *pending], ignore_index=True)
                held = None
                for at in range(0, len(rows), 2 * block):
                    mine = rows.iloc[at : at + 2 * block] if held is None else pd.concat([held, rows.iloc[at : at + 2 * block]])
                    done, held = flush(mine.reset_index(drop=True), False)
                    if len(done):
                        yield done
                pending, waiting = [], 0
        rows = pd.concat([*([held] if held is not None else []), *pending], ignore_index=True) if held is not None or pending else None
        if rows is not None and len(rows):
            yield flush(rows, True)[0]

    return run


def pieces(sized: DataFrame, *, capacity: int = CAPACITY, loss: str | None = None, loss_capacity: int | None = None) -> DataFrame:
    """One row per piece: a text above the capacity is cut into as few pieces as can be, the others stay whole.

    sized: n_tokens and any other columns; `loss`, a column with the loss-bearing tokens of a text (null: none), else all
    tokens but a piece's first, which nothing predicts. A cut text's loss-bearing tokens are shared out over its pieces.
    """
    cap = capacity if loss_capacity is None else min(capacity, loss_capacity)
    n = F.coalesce("n_tokens", F.lit(0))
    cuts = F.when(n <= cap, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(cap)))
    out = sized.drop("token_start", "piece").withColumn("__all", n).select("*", F.posexplode(cuts).alias("piece", "token_start"))
    out = out.withColumn("n_tokens", F.when(F.col("__all") <= cap, F.col("__all")).otherwise(F.least(F.lit(cap), F.col("__all") - F.col("token_start"))).cast("int"))
    bearing = F.greatest(F.col("n_tokens") - 1, F.lit(0)) if loss is None else F.least(F.col("n_tokens"), F.greatest(F.coalesce(F.col(loss), F.lit(0)) - F.col("token_start"), F.lit(0)))
    return out.withColumn("loss_tokens", bearing.cast("int")).drop("__all")


def pack(sized: DataFrame, *, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: str | None = None, loss_capacity: int | None = None, block: int = BLOCK) -> DataFrame:
    """Assigns every text to containers; the columns of `sized` plus piece, token_start, loss_tokens, container_id, segment.

    n_tokens becomes that of the piece. Only a text above the capacity is cut; token ranges of a text's pieces tile it, so
    each token comes out exactly once. Texts without tokens take a segment and no room. Null sizes count as 0. No container
    exceeds any of the three limits; its id is unique over the whole result and follows from the partition and order of
    the rows, so a task that is run again gives the same ids. An empty table gives an empty table.
    """
    if min(capacity, segments, capacity if loss_capacity is None else loss_capacity) < 1:
        raise ValueError("limits must be at least 1")
    rows = pieces(sized.drop("container_id", "segment", "loss_tokens"), capacity=capacity, loss=loss, loss_capacity=loss_capacity)
    schema = rows.withColumn("container_id", F.lit(0).cast("long")).withColumn("segment", F.lit(0)).schema
    pack_with = lambda final: _packer(capacity, segments, capacity if loss_capacity is None else loss_capacity, block, final)
    first = materialize(rows.mapInPandas(pack_with(False), schema), "packed")
    rest = first.filter("container_id < 0").drop("container_id", "segment")
    rest = rest.repartition(max(1, -(-rest.count() // GATHER)))
    # in one order however the rows arrive, sizes mixed
    rest = rest.sortWithinPartitions(F.xxhash64(*[f.name for f in rest.schema.fields if f.dataType.typeName() not in ("map", "variant")]), "n_tokens")
    return first.filter("container_id >= 0").unionByName(rest.mapInPandas(pack_with(True), schema))
