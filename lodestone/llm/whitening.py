"""Embedding whitening (operator 13) with distributed block matrices.

Entries become whole numbers, so that the number of distinct vectors and their sums are exact. Centred rows are set into
the blocks of an MLlib BlockMatrix; its transpose times itself is the scatter, whose eigenvectors the driver finds (a
matrix of the dimension's size, whatever the number of rows); a block product with the whitening matrix projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, written

#: What an entry is multiplied by before it is rounded down, and what is added then.
SCALE, SHIFT = 64, 1_000_000
#: Larger products count as so much, so that no sum leaves 64 bits.
LARGEST = 1 << 61
#: Rows of a block; how many blocks of either factor meet in one task of a product; the least variance of a component, as a share of the largest.
BLOCK_ROWS, BLOCKS_A_TASK, LEAST_SHARE = 1024, 32, 1e-11


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: vectors of whole numbers. Rows whose vector is null, empty or holds null, NaN or infinite entries are left out."""
    v = F.col(vector_col)
    wrong = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("size(v) > 0").filter(~F.exists("v", wrong))
    return rows.select("vec_id", F.transform("v", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * SCALE))) + SHIFT).alias("x"))


def dimension(vectors: DataFrame) -> int:
    """The commonest length of the vectors, of several the largest; 0 without any."""
    row = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def column_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sums of the d entries)."""
    sums = vectors.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # d rows
    by = {r.pos: r for r in sums}
    return (by[0].n, [int(by[k].s) for k in range(d)]) if by else (0, [])


def _centre(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n x - S) / n as doubles and the sum of the squares of n x - S for each row, exact; null where that is no long."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums))
    if most < 1 << 61:
        d = x * n - np.array(sums, np.int64)
    else:
        d = x.astype(object) * n - np.array(sums, object)
    far = max((abs(int(v)) for v in (d.max(initial=0), d.min(initial=0))), default=0)
    squares = (d * d).sum(axis=1) if d.dtype != object and far * far * d.shape[1] < 1 << 63 else (d.astype(object) ** 2).sum(axis=1)
    return (d / n).astype(np.float64), [int(s) if s < 1 << 63 else None for s in squares.tolist()]


def centred_blocks(vectors: DataFrame, n: int, sums: list[int], rows: int = BLOCK_ROWS) -> DataFrame:
    """part, k, ids, deviations, cells: blocks of `rows` centred rows each, cells by columns; a part's last block is filled up with rows of zeros, which add nothing to a product."""
    d = len(sums)
    schema = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("ids", pa.list_(pa.int64())), ("deviations", pa.list_(pa.int64())), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        ids: list = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            centred, deviations = _centre(np.concatenate(held), n, sums)
            cells = np.zeros((rows, d))
            cells[: len(centred)] = centred
            out = pa.record_batch([[part], [next(number)], pa.array([ids], schema.field("ids").type), pa.array([deviations], schema.field("deviations").type), [cells.tobytes("F")]], schema=schema)
            held.clear()
            return out

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - len(ids), batch.num_rows - at)
                piece = batch.slice(at, take)
                held.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(take, d))
                ids.extend(piece.column(0).to_pylist())
                at += take
                if len(ids) == rows:
                    yield block()
                    ids.clear()
        if ids:
            yield block()
        give_back()

    small_batches(vectors.sparkSession)
    return vectors.select("vec_id", "x").mapInArrow(run, "part long, k long, ids array<long>, deviations array<long>, cells binary")


def _indexed(blocks: DataFrame, name: str) -> DataFrame:
    """Written blocks with a number each: those of the parts in turn, so numbers have few holes; a missing block is one of zeros."""
    table = written(blocks, name)
    return table.withColumn("block", F.col("k") * (F.coalesce(table.agg(F.max("part").alias("p")).scalar(), F.lit(0)) + 1) + F.col("part"))


def _matrix(blocks: DataFrame, rows: int, d: int) -> BlockMatrix:
    cells = blocks.select("block", "cells").rdd.map(lambda r: ((r[0], 0), DenseMatrix(rows, d, np.frombuffer(r[1], np.float64))))
    return BlockMatrix(cells, rows, d)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right; the sums over the middle dimension are shared by so many tasks."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(x: BlockMatrix, blocks: int) -> np.ndarray:
    return _times(x.transpose(), x, max(1, -(-blocks // BLOCKS_A_TASK))).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, columns that whiten) of at most `most` components, by falling eigenvalue; directions without variance have none."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(0.0, LEAST_SHARE * values.max(initial=0.0))]
    return values[order], vectors[:, order] / np.sqrt(values[order])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component (from 1, at most `most`).

    Fitted on the distinct vectors of whole numbers. Left out are vectors that are null, empty or hold null or non-finite
    entries, and those of another length than the commonest. Rows that repeat an id or a vector are projected each; null ids
    stay; other columns aren't read. There are no components without variance, so none for a single distinct vector; no
    rows give no rows. deviation is null where it is no 64-bit number. The driver holds matrices of the dimension's size only.
    """
    spark = df.sparkSession
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = written(whole_vectors(df, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    d = dimension(vectors)
    if not d:
        return spark.createDataFrame([], result)
    vectors = vectors.filter(F.size("x") == d)
    distinct = written(vectors.select("x").distinct().select(F.lit(None).cast("long").alias("vec_id"), "x"), "distinct")
    n, sums = column_sums(distinct, d)
    fit = _indexed(centred_blocks(distinct, n, sums, rows), "fit")
    number = fit.count()
    x = _matrix(fit, rows, d)
    covariance = _scatter(x, number) / n
    values, to_white = whitening_matrix(covariance, most)
    c = len(values)
    if not c:
        return spark.createDataFrame([], result)

    def project(matrix: BlockMatrix) -> BlockMatrix:
        return _times(matrix, BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, c, to_white.ravel("F")))], 1), d, c))

    # The covariance of what came out, centred anew: its sums are as good as 0, but not taken for granted.
    white = project(x)
    means = white.blocks.map(lambda b: b[1].toArray().sum(axis=0)).treeReduce(lambda a, b: a + b) / n
    filled = {r.block: r.n for r in fit.select("block", F.size("ids").alias("n")).filter(F.col("n") < rows).collect()}  # a part's last blocks
    again = BlockMatrix(white.blocks.map(lambda b: (b[0], _less(b[1], means, filled.get(b[0][0], rows)))), rows, c)
    error = float(np.abs(_scatter(again, number) / n - np.eye(c)).max())
    own = _indexed(centred_blocks(vectors, n, sums, rows), "blocks")
    cells = project(_matrix(own, rows, d)).blocks.map(lambda b: (int(b[0][0]), b[1].toArray().ravel("C").tolist()))
    projected = spark.createDataFrame(cells, "block long, cells array<double>")
    share = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    each = own.select("block", "ids", "deviations").join(projected, "block").select("cells", F.posexplode(F.arrays_zip("ids", "deviations")).alias("at", "row"))
    parts = each.select("row", F.posexplode(F.slice("cells", F.col("at") * c + 1, F.lit(c))).alias("k", "whitened"))
    return parts.select(F.col("row.ids").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("row.deviations").alias("deviation"), "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))


def _less(block: DenseMatrix, means: np.ndarray, rows: int) -> DenseMatrix:
    """A block less the means, in its first `rows` rows; the rest stay zeros."""
    cells = block.toArray()
    cells[:rows] -= means
    return DenseMatrix(cells.shape[0], cells.shape[1], cells.ravel("F"))
