"""Shards through fixed virtual slots.

A record is hashed into one of a few thousand slots, for good.  A small versioned
map says which shard owns a slot; rebalancing edits the map and moves whole slots.
All work on rows is DataFrame functions; the driver only sees one row per slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def measured(rows: DataFrame, key: Column, size: Column, slots: int = SLOTS) -> DataFrame:
    """Add ``vslot`` (0 to slots - 1) and ``size``; a null key has a slot like any other."""
    return rows.withColumns({"size": size.cast("long"),
                             "vslot": F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")})


def loads(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot: ``slots`` numbers each, whatever the input."""
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.s or 0, r.n
    return size, count


def even_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 1: slots dealt round."""
    return np.arange(slots) % shards


def rebalanced(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """Edit a map until no single move or swap of slots narrows a fuller and an emptier shard.

    ``shards`` may be larger than before: new shards start empty and are filled
    by moves.  Slots that need not move keep their shard.
    """
    owner = owner.copy()
    held = np.bincount(owner, weights=size, minlength=shards).astype(np.int64)
    stuck = np.zeros(shards, bool)  # shards of one large slot, say, that no move helps
    for _ in range(50 * len(size)):
        # The fullest shard gives to the emptiest one that can improve on it.
        full = int(np.argmax(np.where(stuck, -1, held)))
        best = None
        mine = np.flatnonzero(owner == full)
        for low in np.argsort(held, kind="stable"):
            gap = int(held[full] - held[low])
            if low == full or gap <= 1:
                break
            theirs = np.flatnonzero(owner == low)
            # Moving x and taking y back changes the gap by 2 (x - y); aim at half of it.
            # A move takes nothing back (an entry of zero bytes).
            back = np.append(size[theirs], 0)
            order = np.argsort(back, kind="stable")
            at = np.clip(np.searchsorted(back[order], size[mine] - gap / 2), 0, len(back) - 1)
            for near in (at, np.maximum(at - 1, 0)):
                step = size[mine] - back[order[near]]
                left = np.where((step > 0) & (step < gap), np.abs(gap - 2 * step), gap)
                k = int(np.argmin(left))
                if left[k] < gap and (best is None or left[k] < best[0]):
                    best = (left[k], mine[k], order[near[k]], step[k])
            if best is not None:
                break
        if best is None:
            stuck[full] = True
            if stuck.all():
                return owner
            continue
        stuck[:] = False
        owner[best[1]] = low
        if best[2] < len(theirs):
            owner[theirs[best[2]]] = full
        held[full] -= best[3]
        held[low] += best[3]
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: np.ndarray, count: np.ndarray) -> None:
    """Store one version; ``base`` is the first place of a slot's rows in its shard."""
    base, so_far = np.zeros(len(owner), np.int64), np.zeros(int(owner.max()) + 1, np.int64)
    for slot, shard in enumerate(owner):
        base[slot] = so_far[shard]
        so_far[shard] += count[slot]
    rows = [(s, int(owner[s]), int(base[s])) for s in range(len(owner))]
    (spark.createDataFrame(rows, "vslot int, shard int, base long").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/version={version}"))


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, base long").parquet(f"{path}/version={version}")


def placed(rows: DataFrame, table: DataFrame, order: list[str]) -> DataFrame:
    """Add ``shard`` and ``slot``, the gapless place of a row inside its shard.

    Rows are numbered inside their virtual slot, so no task holds a whole shard.
    The map has one row per virtual slot and is broadcast.
    """
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    numbered = rows.withColumn("_n", inside)
    return (numbered.join(F.broadcast(table), "vslot")
            .withColumn("slot", F.col("base") + F.col("_n") - 1).drop("_n", "base"))
