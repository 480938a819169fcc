"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (documents of equal text) enter by size, largest first, the shard with the tightest room that holds
them; the shards' rooms are kept in a balanced tree. Groups of one size class are alike, so the driver packs
a histogram: sizes are rounded up to 12 significant bits, which bounds it to some 110,000 entries for any corpus
and costs at most 0.05 % of a shard's room. Ranks in the global order (class, text digest) then say which
shard a group is in. Documents move only by digest, size and id.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import arrow_map, counts_within, global_rank, stored

SHARDS = 24
OVERHEAD = 8  # bytes that a document takes besides its text
SIGNIFICANT = 12


class _Node:
    __slots__ = ("heavy", "key", "left", "right")

    def __init__(self, key: tuple[int, int], heavy: float) -> None:
        self.key, self.heavy, self.left, self.right = key, heavy, None, None


class Rooms:
    """Shards by the room that is left, in a balanced (randomised) search tree."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = random.Random(7)

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.root, (room, shard))
        self.root = self._join(self._join(low, _Node((room, shard), self.random.random())), high)

    def remove(self, room: int, shard: int) -> None:
        low, rest = self._split(self.root, (room, shard))
        _, high = self._split(rest, (room, shard + 1))
        self.root = self._join(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The shard of least room that is still ``size`` or more."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def widest(self) -> tuple[int, int]:
        node = self.root
        while node.right:
            node = node.right
        return node.key

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _join(self, low: _Node | None, high: _Node | None) -> _Node | None:
        if low is None or high is None:
            return low or high
        if low.heavy > high.heavy:
            low.right = self._join(low.right, high)
            return low
        high.left = self._join(low, high.left)
        return high


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int]]:
    """(size, groups, shard) runs for (size, groups) classes, in the order in which groups enter.

    Without ``shards``, a shard opens whenever no open one has room. With it, so many are open from the start, and
    a group that fits nowhere goes where most room is. A group above ``capacity`` has a shard of its own.
    """
    rooms, runs, opened = Rooms(), [], shards or 0
    for k in range(opened):
        rooms.add(capacity, k)
    for size, count in sorted(classes, reverse=True):
        while count:
            if found := rooms.tightest(size):
                room, shard = found
                fit = min(count, room // size)
            elif shards is None:
                room, shard, fit, opened = max(capacity, size), opened, min(count, max(1, capacity // size)), opened + 1
                rooms.add(room, shard)
            else:
                (room, shard), fit = rooms.widest(), 1
            rooms.remove(room, shard)
            rooms.add(room - fit * size, shard)
            runs.append((size, fit, shard))
            count -= fit
    return runs


def even_capacity(classes: list[tuple[int, int]], shards: int) -> tuple[int, int]:
    """The capacity at which ``shards`` shards hold everything, and how many groups are larger than that.

    Such a group fills a shard alone; the others share what the remaining shards can be filled to.
    """
    total, alone = sum(s * n for s, n in classes), 0
    for size, count in sorted(classes, reverse=True):
        for _ in range(min(count, shards - alone)):
            if size * (shards - alone) <= total or alone == shards - 1:
                return -(-total // (shards - alone)), alone
            total, alone = total - size, alone + 1
    return max(1, -(-total // max(1, shards - alone))), alone


def fixed_shards(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs that spread the classes over exactly ``shards`` shards of near-equal size."""
    capacity, alone = even_capacity(classes, shards)
    runs, rest = [], []
    for size, count in sorted(classes, reverse=True):
        own = min(count, alone - len(runs))
        runs += [(size, 1, len(runs) + k) for k in range(own)]
        rest += [(size, count - own)] * (count > own)
    return runs + [(size, n, shard + alone) for size, n, shard in best_fit_decreasing(rest, capacity, shards - alone)]


def size_class(size: Column) -> Column:
    """The size, rounded up to SIGNIFICANT significant bits."""
    shift = F.greatest(F.length(F.bin(size)) - SIGNIFICANT, F.lit(0))
    step = F.pow(F.lit(2), shift).cast("long")
    return (F.floor((size + step - 1) / step) * step).cast("long")


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in the shard) of every row.

    Either so many ``shards`` of near-equal bytes, or as few shards of ``capacity`` bytes as best fit gives. Equal
    texts stay together; null and empty texts form one group of size 8 a row. Repeated rows and null ids
    keep their rows. A very long text is never cut. An empty table has no shards. Other columns are not read.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(id_column, (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("__text")))
    groups = rows.groupBy("__text").agg((F.count("*") * F.first("size")).alias("__bytes")).withColumn("__class", size_class(F.col("__bytes")))
    ranked = stored(global_rank(groups.select("__text", "__class"), [F.col("__class").desc(), "__text"], "__rank"))
    classes = [(r["__class"], r["n"]) for r in ranked.groupBy("__class").agg(F.count("*").alias("n")).collect()]  # bounded: SIGNIFICANT
    runs = fixed_shards(classes, shards) if shards else best_fit_decreasing(classes, capacity)
    starts = np.cumsum([0, *(n for _, n, _ in runs)], dtype=np.int64)[:-1]
    table = docs.sparkSession.sparkContext.broadcast((starts, np.array([s for _, _, s in runs], np.int32)))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, shard = table.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard[np.searchsorted(starts, batch.column(1).to_numpy(), "right") - 1])], names=["__text", "shard"])

    placed = arrow_map(ranked.select("__text", "__rank"), step, "__text binary, shard int")
    return counts_within(rows.join(placed, "__text").drop("__text"), "shard", "slot")
