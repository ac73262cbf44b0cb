"""Sharding (operator 6): best-fit-decreasing bin packing of groups of equal texts.

Groups are indivisible. Sorted by size, each enters the shard with the tightest room that holds it, found in a balanced
tree. What decides is how many groups there are of each size: groups of B bytes in all have less than sqrt(2 B) different
sizes, so this table is small where the data is large, and one task packs it. The groups of a size are then numbered and
dealt to the shards that the packing gave their numbers. All sizes, digests, numbers and positions are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import look_up, written

#: Groups of one size whose places are looked up together.
BLOCK = 10_000


class RoomTree:
    """A balanced (AVL) tree of (room, bin) pairs: insert, and take the smallest that is at least (size, 0)."""

    def __init__(self):
        self.root = None  # nodes are [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fix(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 2, 1)
            return self._turn(node, 1, 2)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 1, 2)
            return self._turn(node, 2, 1)
        return node

    def _turn(self, node, up: int, down: int):
        top = node[up]
        node[up], top[down] = top[down], node
        for x in (node, top):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return top

    def insert(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fix(node)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node, k):
            if k != node[0]:
                side = 1 if k < node[0] else 2
                node[side] = cut(node[side], k)
                return self._fix(node)
            if not node[1] or not node[2]:
                return node[1] or node[2]
            after = node[2]
            while after[1]:
                after = after[1]
            node[0] = after[0]
            node[2] = cut(node[2], after[0])
            return self._fix(node)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0] >= (size, 0):
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best

    def roomiest(self) -> tuple[int, int]:
        node = self.root
        while node[2]:
            node = node[2]
        return node[0]


def best_fit_runs(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Best-fit decreasing over (size, how many) in falling order of size: yields (size, first, count, bin) for the items first to first + count of that size.

    An item goes into the bin with the tightest room that holds it. That bin then has less room than any other that would
    do, so it takes items of the same size until it holds no more: equal sizes enter bin by bin, not one by one. With bins
    given, all are open from the start, and what fits none goes to the roomiest; else bins open as needed, and a size over
    the capacity gets one of its own.
    """
    tree, made = RoomTree(), bins or 0
    for b in range(made):
        tree.insert((capacity, b))
    for size, left in sizes:
        first = 0
        while left:
            found = tree.tightest(size)
            if found is not None:
                tree.remove(found)
            elif bins:
                found = tree.roomiest()
                tree.remove(found)
            else:
                found, made = (capacity, made), made + 1
            room, b = found
            count = max(1, min(left, room // size))
            tree.insert((room - count * size, b))
            yield size, first, count, b
            first, left = first + count, left - count


def place_groups(sizes: np.ndarray, counts: np.ndarray, shards: int | None, capacity: int | None) -> Iterator[tuple[int, int, int, int]]:
    """(size, first, count, shard) for all groups, given as how many there are of each size, in falling order of size.

    With shards given, a group over an equal share of what is left has a shard of its own, and the rest is shared out anew.
    """
    if not shards:
        yield from best_fit_runs(zip(sizes.tolist(), counts.tolist(), strict=True), capacity)
        return
    total, alone, at, taken = int((sizes * counts).sum()), 0, 0, 0
    while at < len(sizes) and alone < shards - 1 and sizes[at] > -(-total // (shards - alone)):
        yield int(sizes[at]), taken, 1, alone
        total, alone, taken = total - int(sizes[at]), alone + 1, taken + 1
        if taken == counts[at]:
            at, taken = at + 1, 0
    left = counts[at:].copy()
    left[:1] -= taken
    own = shards - alone
    for size, first, count, b in best_fit_runs(zip(sizes[at:].tolist(), left.tolist(), strict=True), -(-total // own), own):
        yield size, first + (taken if at < len(sizes) and size == sizes[at] else 0), count, alone + b


def _placed(groups: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """bytes, first, count, shard of runs of groups of one size: one task over the sizes, of which there are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        sizes, counts = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*parts, strict=True) if parts else ((), ())))
        order = np.argsort(-sizes)
        out: list[tuple[int, int, int, int]] = []
        for one in place_groups(sizes[order], counts[order], shards, capacity):
            out.append(one)
            if len(out) >= 100_000:
                yield _runs(out)
                out = []
        yield _runs(out)

    sizes = written(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return sizes.coalesce(1).mapInArrow(run, "bytes long, first long, count long, shard int")


def _runs(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["bytes", "first", "count", "shard"])


def _numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with numbers from 0 within each key, without gaps. Column part says which task wrote a row: rows are numbered within
    (key, part), which no task has more of than it read, and parts follow each other."""
    sizes = df.groupBy(key, "part").agg(F.count(F.lit(1)).alias("m"))
    behind = F.sum("m").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(key, "part", F.coalesce(behind, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    return df.withColumn("place", place).join(before, [key, "part"]).withColumn(name, (F.col("before") + F.col("place")).cast("long")).drop("before", "place")


def _measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part: Column = F.spark_partition_id().alias("part")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), part)


def shard(df: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of df.

    Size is the text's UTF-8 bytes plus 1; a null text is an empty one. Rows of equal text are one group and always stay
    together. With shards given, each gets a near equal share of all bytes, but for a group over that share, which fills a
    shard by itself while the others share the rest; else shards of `capacity` bytes are opened as needed, as few as
    best-fit decreasing finds, and a larger group gets one of its own. Slots count from 0 in each shard without gaps.
    Groups of one size are interchangeable. Null ids and repeated rows are rows like others. No rows, no shards.
    """
    rows = written(_measured(df, id_col, text_col), "measured")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("part", F.spark_partition_id())
    groups = written(groups, "groups")
    runs = written(_placed(groups, shards, capacity), "runs")
    spread = runs.select("bytes", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + count - 1) div {BLOCK})")).alias("block"), "first", "shard")
    blocks = spread.groupBy("bytes", "block").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    ranked = _numbered(groups, "bytes", ["digest"], "number").withColumn("block", F.expr(f"number div {BLOCK}"))
    own = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)["shard"]
    placed = written(ranked.join(blocks, ["bytes", "block"]).select("digest", "n", own.alias("shard")), "placed")
    tagged = written(look_up(rows, placed, "digest").drop("digest", "n"), "tagged")
    return _numbered(tagged, "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
