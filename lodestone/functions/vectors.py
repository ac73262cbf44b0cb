"""Vector expressions over array<float>: dot product, norm, cosine, weighted mean, the hash embedder, the byte codec."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double; arrays of different length give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def to_bytes(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def from_bytes(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))


def hash_embed(text: str, dim: int) -> list[float]:
    """The hash embedding of one query text, as hash_embedding() gives it for a column."""
    out: list[float] = []
    block = 0
    while len(out) < dim:
        digest = hashlib.sha256(struct.pack("<I", block) + text.encode()).digest()
        out += [w / 4294967295 * 2 - 1 for w in struct.unpack("<8I", digest)]
        block += 1
    return out[:dim]


def hash_embedding(text: Column, dim: int) -> Column:
    """dim numbers from -1 to 1: the little-endian words of SHA-256 over a little-endian block number and the text."""

    def words(digest: Column) -> Column:
        def word(i: int) -> Column:
            at = 8 * i + 1
            return F.conv(F.concat(*[F.substring(digest, at + 2 * b, 2) for b in (3, 2, 1, 0)]), 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1

        return F.array(*[word(i) for i in range(8)])

    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    digests = F.array(*[F.sha2(F.concat(F.unhex(F.lit(struct.pack("<I", k).hex())), data), 256) for k in range(-(-dim // 8))])
    # The digests are a lambda's variable, so each is computed once for its eight words.
    return F.slice(F.flatten(F.transform(digests, words)), 1, dim)


def weighted_mean(df: DataFrame, by: list[str], vector: str, weight: str) -> DataFrame:
    """by, mean: the weighted mean vector of each group. Groups whose weights add up to 0 are left out. Sums combine before the shuffle."""
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"), F.col(weight).cast("double").alias("w"))
    sums = long.groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w")).filter("w != 0")
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("w")).alias("v"))))
    return sums.groupBy(*by).agg(F.transform(ordered, lambda p: p["v"]).alias("mean"))
