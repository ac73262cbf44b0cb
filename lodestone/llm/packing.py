"""Best-fit packing (operator 4): bound-certified repacking.

Documents become token ids; long ones are cut into pieces of full length (the first may be shorter). Each bucket of
pieces is packed by best-fit decreasing, and dual feasible functions give a lower bound on its sequences. A bucket that
meets its bound is certified and gives up its emptiest sequence only; a bucket with a gap gives up every sequence
that isn't full. What is given up meets in fewer buckets and is packed again, until few pieces are left.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pass, texts, written

# The pattern by which byte-level vocabularies cut a text into the strings that are merged each for itself.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the encoders call differently; a long run of white space.
_ODD, _BLANK = "\x1c\x1d\x1e\x1f\x85", re.compile(r"\s{200}")


def _hard(text: str) -> bool:
    """Is there a stretch that only the slower encoder takes in reasonable time, or a character that they call differently?"""
    return any(c in text for c in _ODD) or len(text) >= 200 and (_BLANK.search(text) is not None or max(map(len, text.split()), default=0) >= 2000)


@lru_cache(maxsize=1)
def _whole(path: str):
    """The tokenizer of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=1)
def _fast(path: str):
    """A faster encoder of the same vocabulary and pattern, made from the file alone: most workers never load the other."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content["added_tokens"]}
    # Byte-level vocabularies write each byte as a printable character: itself where that is one, else from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spell = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(map(spell.__getitem__, t)): i for t, i in content["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes; strings of special tokens are ordinary text.

    The ids are those of the tokenizer's file. Both encoders read its vocabulary; the faster one, which is the usual one,
    leaves texts with extreme stretches to the other.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, _fast(path)

    @property
    def whole(self):
        return _whole(self.path)

    def encode(self, batch: list[str]) -> list[bytes]:
        out = []
        for text in batch:
            ids = self.whole.encode(text, add_special_tokens=False).ids if _hard(text) else self.fast.encode_ordinary(text)
            out.append(np.array(ids, "<u4").tobytes())
        return out


def token_pieces(df: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 for each piece (and ids, as little-endian unsigned 32-bit bytes, if with_ids).

    row numbers the rows of df (by task, so only a written result keeps them). A document is its text's ids, then end_id; a null or empty text is end_id alone. vocabulary is the path of a
    tokenizer file that workers can read.
    """
    last = np.array([end_id], "<u4").tobytes()

    def make():
        encoder, row = TokenIds(vocabulary), count(TaskContext.get().partitionId() << 33)

        def work(batch):
            out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32", "ids")}
            ids = batch.column(0).to_pylist()
            for doc, code in zip(ids, encoder.encode(texts(batch.column(1))), strict=True):
                code += last
                n = len(code) // 4
                at, k, own = 0, 0, next(row)
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    part = code[4 * at : 4 * (at + size)]
                    for name, value in (("doc_id", doc), ("row", own), ("piece", k), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(part)), ("ids", part if with_ids else None)):
                        out[name].append(value)
                    at, k = at + size, k + 1
            return out

        return work

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The most bins that dual feasible functions prove necessary for the sizes (each from 1 to capacity)."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity) if len(sizes) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same, for count[x] pieces of each size x up to the capacity."""
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    number, weight = np.cumsum(count), np.cumsum(count * x)
    for k in range(1, capacity // 2 + 1):  # sizes over capacity - k count as whole bins, sizes below k not at all
        total = capacity * (number[-1] - number[capacity - k]) + weight[capacity - k] - weight[k - 1]
        best = max(best, -(-int(total) // capacity))
    for p in range(1, 33):  # sizes are rounded to multiples of 1 / p, except where (p + 1) x is whole
        scaled = np.where((p + 1) * x % capacity == 0, p * x, capacity * ((p + 1) * x // capacity))
        best = max(best, -(-int((count * scaled).sum()) // (p * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, into the tightest bin that holds it. Ties: the given order, the newest bin."""
    bins, room, open_by_room = np.empty(len(sizes), np.int64), 0, [[] for _ in range(capacity + 1)]
    used = 0  # bit r is set if a bin with r left is open
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = used >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                used ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        if left := room - size:
            open_by_room[left].append(b)
            used |= 1 << left
    return bins


_PACKED = "row long, piece int, length long, bucket long, bin long, offset long, given_up boolean"


def _pack_bucket(capacity: int, final: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        given = np.zeros(len(fill), bool)
        if not final:
            if len(fill) > lower_bound(sizes, capacity):
                given = fill < capacity
            else:
                given[fill.argmin()] = fill.min() < capacity
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return rows[["row", "piece", "length", "bucket"]].assign(bin=bins, offset=offset, given_up=given[bins])

    return run


def certificate(placed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """(sequences, the number that dual feasible functions prove necessary for all pieces together): how far a packing can be from the best."""
    lengths = placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        count[r.length] = r.n
    return placed.select("sequence_id").distinct().count(), bound_of_counts(count, capacity) if lengths else 0


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """row, piece, length, sequence_id, offset for each of the pieces (row, piece, length).

    bucket_rows bounds what one task packs. What is given up meets again in ever fewer buckets, until it fits one bucket or
    a round has given up more than half of what it got, so that a further one would gain little; in that last round nothing
    is given up. Full pieces are sequences of their own.
    """
    spread = F.xxhash64("row", "piece")
    full = pieces.filter(F.col("length") >= capacity).select("row", "piece", "length", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity).select("row", "piece", "length")
    done = [full]
    k, before = 0, None
    while n := left.count():
        buckets = -(-n // bucket_rows)
        final = buckets == 1 or before is not None and 2 * n > before
        dealt = left.withColumn("bucket", F.pmod(spread, F.lit(buckets)))
        packed = written(dealt.groupBy("bucket").applyInPandas(_pack_bucket(capacity, final), _PACKED), f"packed{k}")
        # Sequence ids: the round in the top bits, then the bucket, then the bin (less than bucket_rows by far).
        ids = F.lit(k << 58) + F.shiftleft("bucket", 30) + F.col("bin")
        done.append(packed.filter("not given_up").select("row", "piece", "length", ids.alias("sequence_id"), "offset"))
        left = packed.filter("given_up").select("row", "piece", "length")
        k, before = k + 1, n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Offsets are gapless from 0 in each sequence, which holds `capacity` tokens at most. A null text is an empty one. Rows
    that repeat a doc_id (or a null one) are numbered apart while packing and each get their pieces. No rows, no pieces.
    """
    pieces = written(token_pieces(df, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    placed = pack(pieces.select("row", "piece", "length"), capacity, bucket_rows)
    return pieces.join(placed.drop("length"), ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
