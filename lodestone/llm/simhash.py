"""SimHash near-dedup (operator 10): a binary trie self-join over distinct fingerprints.

Fingerprints are 64 bits; two link when at most `errors` bits differ. The 64 bits are cut into `blocks` blocks; whatever
differs in at most `errors` bits agrees in blocks - errors blocks, so for each choice of that many blocks the fingerprints
are dealt by these bits (a subtree of the trie that reads them first) and each subtree is joined with itself: pairs of
trie nodes are descended together, differing bits add up, and a pair of nodes over the budget is pruned. A subtree with
more than `limit` fingerprints is cut into chunks and joined chunk pair by chunk pair, so no task holds a whole one.
A task returns a spanning forest of its links, not the links; components of all forests are then found in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, look_up, text_pass, utf8, written

#: Products of node sizes up to this are compared outright; pairs compared at once; rows of a task's block.
LEAF, CHUNK, BLOCK = 64, 1 << 20, 200_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text; 0 without words."""
    seen = text.lower().split()
    if not seen:
        return 0
    whole = b" ".join(seen)
    if len(seen) <= words:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        after = np.cumsum(np.fromiter(map(len, seen), np.int64, len(seen)) + 1)
        starts, ends = [0, *after[:-words].tolist()], (after[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], seed) for s, e in zip(starts, ends, strict=True)]
    octets, ones = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for at in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; a null or blank text has fingerprint 0."""

    def make():
        def work(batch):
            return {"doc_id": batch.column(0), "fp": np.array([fingerprint(x) for x in utf8(batch.column(1))], np.uint64).view(np.int64)}

        return work

    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, "doc_id long, fp long")


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; labels point to the smallest index of each component, before and after."""
    while True:
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (further := labels[labels] != labels).any():
            labels[further] = labels[labels[further]]


def trie_forest(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, errors: int) -> np.ndarray:
    """For fingerprints sorted within each of the groups [start, end): the index of the smallest one that each is linked to, however far."""
    labels = np.arange(len(fp))

    def leaves(a, m, b, n, same):
        """Compares all of [a, a+m) with all of [b, b+n)."""
        size = m * n
        for lo in _cuts(size):
            aa, mm, bb, nn, ss, zz = a[lo], m[lo], b[lo], n[lo], same[lo], size[lo]
            pair = np.repeat(np.arange(len(zz)), zz)
            at = np.arange(int(zz.sum())) - np.repeat(np.cumsum(zz) - zz, zz)
            i, j = aa[pair] + at // nn[pair], bb[pair] + at % nn[pair]
            near = (~ss[pair] | (i < j)) & (np.bitwise_count(fp[i] ^ fp[j]) <= errors)
            if near.any():
                _hook(labels, i[near], j[near])

    lo1, hi1 = starts.astype(np.int64), ends.astype(np.int64)
    keep = hi1 - lo1 > 1
    lo1, hi1 = lo1[keep], hi1[keep]
    lo2, hi2, err, same = lo1, hi1, np.zeros(len(lo1), np.int64), np.ones(len(lo1), bool)
    for depth in range(63, -2, -1):
        m, n = hi1 - lo1, hi2 - lo2
        small = (m * n <= LEAF) if depth >= 0 else np.ones(len(m), bool)
        if small.any():
            leaves(lo1[small], m[small], lo2[small], n[small], same[small])
            lo1, hi1, lo2, hi2, err, same = (x[~small] for x in (lo1, hi1, lo2, hi2, err, same))
        if not len(lo1):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(depth)) & np.uint64(1))]).astype(np.int64)
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        cross = ~same
        parts = [
            (lo1, mid1, lo2, mid2, err, same),
            (mid1, hi1, mid2, hi2, err, same),
            (lo1, mid1, mid2, hi2, err + 1, np.zeros_like(same)),
            tuple(x[cross] for x in (mid1, hi1, lo2, mid2, err + 1, same)),
        ]
        lo1, hi1, lo2, hi2, err, same = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (err <= errors) & (hi1 > lo1) & (hi2 > lo2) & ~(same & (hi1 - lo1 < 2))
        lo1, hi1, lo2, hi2, err, same = (x[live] for x in (lo1, hi1, lo2, hi2, err, same))
    return labels


def _cuts(size: np.ndarray) -> Iterator[slice]:
    """Slices of about CHUNK in sum."""
    if not len(size):
        return
    marks = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1
    for a, b in zip([0, *marks.tolist()], [*marks.tolist(), len(size)], strict=True):
        if b > a:
            yield slice(a, b)


def _join_sorted(errors: int):
    """Over a partition sorted by (task, fp): forest links (a, b) of each task's group."""

    def links(task: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        marks = np.flatnonzero(task[1:] != task[:-1]) + 1
        starts, ends = np.concatenate([[0], marks]), np.concatenate([marks, [len(task)]])
        labels = trie_forest(fp, starts, ends, errors)
        own = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.record_batch([pa.array(fp[own].view(np.int64)), pa.array(fp[labels[own]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            task = np.concatenate([task, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(task) >= BLOCK and (cut := int(np.searchsorted(task, task[-1]))):
                yield links(task[:cut], fp[:cut])
                task, fp = task[cut:], fp[cut:]
        if len(task):
            yield links(task, fp)

    return run


def _subtrees(errors: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each choice of blocks that agree: their (offset, width)."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(cut, blocks - errors)]


def link_forest(fps: DataFrame, errors: int = 4, blocks: int = 6, limit: int = 16_384) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that join all that differ in at most `errors` bits."""

    def key(t: int, parts: list[tuple[int, int]]):
        bits = F.lit(t).cast("long")
        for offset, width in parts:
            bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return bits

    tagged = fps.select("fp", F.explode(F.array(*[key(t, p) for t, p in enumerate(_subtrees(errors, blocks))])).alias("task"))
    hot = tagged.groupBy("task").count().filter(F.col("count") > limit).select("task", F.ceil(2 * F.col("count") / limit).alias("chunks"))
    hot = written(hot, "hot")
    if hot.take(1):
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("task", F.least(c, "own"), F.greatest(c, "own")))
        cut = tagged.join(hot, "task").withColumn("own", own).select("fp", F.explode(pairs).alias("task"))
        # A chunk pair's number is a hash; two that share it are joined together, which adds no wrong link: only bits decide.
        tagged = tagged.join(hot, "task", "left_anti").select("fp", "task").unionByName(cut)
    dealt = tagged.select("task", "fp").repartition(F.col("task")).sortWithinPartitions("task", F.expr("fp < 0"), "fp")
    return dealt.mapInArrow(_join_sorted(errors), "a long, b long").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 4, blocks: int = 6, limit: int = 16_384) -> DataFrame:
    """doc_id, fp, component_id for each row of df: the smallest doc_id that links of fingerprints reach, itself included.

    Rows of one fingerprint are linked with each other (so are all texts without words, null ones included). Rows with a
    null id take part but never name a component unless all its ids are null. Repeated rows each get a row. No rows give
    no rows. Texts are read whole; no partner, candidate or group is capped.
    """
    own = written(fingerprints(df, id_col, text_col), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = connected_components(link_forest(fps.select("fp"), errors, blocks, limit))
    labels = labels.select(F.col("v").alias("fp"), "label")
    named = written(fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    # A large component's label is one key of many fingerprints: looked up like a hot text.
    ids = written(look_up(named.select("fp", "n", "label"), least, "label", "size").select("fp", "n", "component_id"), "components")
    return look_up(own, ids, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df's columns; of each group of near_groups() the rows whose id names it. Rows that share an id stand or fall together."""
    groups = near_groups(df, id_col, text_col, **how)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__lodestone_id")).distinct()
    return df.join(kept, df[id_col].cast("long").eqNullSafe(F.col("__lodestone_id")), "left_semi")
