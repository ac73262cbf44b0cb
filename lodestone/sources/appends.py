"""Appending many blocks to few, maybe very large files, in order: each task writes its own range of bytes.

Blocks are dealt by ranges of (path, order), so a file that gets most of them is written by many tasks; where a block
begins is a sum over the blocks before it, taken within the ranges and then over their totals. No file is read or held
whole. The folder is one that all executors share (see vault.write_texts).

A file's size before stands in a journal beside it until its last block is written: a run after a broken one cuts the
file back to it first, so nothing is appended twice. What was written where is a table, by which blocks are taken back.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import by_bytes

#: Bytes that a task copies at once.
COPY = 32 << 20
JOURNAL = ".append-journal"


def _inside(root: str, path: str) -> str:
    target = os.path.normpath(os.path.join(root, path))
    if not target.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{path} leaves the folder")
    return target


def _end_of_array(target: str, size: int) -> tuple[int, bool]:
    """Where the last bracket of a JSON array stands, and whether the array has elements; (0, False) for a file that is none."""
    with open(target, "rb") as file:
        head = file.read(4096).lstrip()
        at, tail = size, b""
        while at and head[:1] == b"[":
            step = min(at, 4096)
            at -= step
            file.seek(at)
            tail = file.read(step) + tail
            body = tail.rstrip()
            if body and not body.endswith(b"]"):
                break
            inner = body[:-1].strip()
            if body and (at == 0 or inner not in (b"", b"[")):
                return at + len(body) - 1, inner != b"["
    return 0, False


def _open(root: str, arrays: set[str]) -> Callable:
    """path -> base (where new bytes begin), filled (whether something stands before them): undoes a broken run, then notes the size in a journal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                target = _inside(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                journal = target + JOURNAL
                if os.path.exists(journal):
                    with open(journal, encoding="ascii") as file:
                        size, tail = file.read().split(":", 1)
                    with open(target, "ab") as file:
                        file.truncate(int(size))
                        file.write(bytes.fromhex(tail))
                size = os.path.getsize(target) if os.path.exists(target) else 0
                base, filled, tail = size, size > 0, b""
                if path in arrays and size:
                    base, filled = _end_of_array(target, size)
                    with open(target, "rb") as file:
                        file.seek(base)
                        tail = file.read() if base else b""  # the closing bracket and what follows it
                part = f"{journal}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="ascii") as file:
                    file.write(f"{base if tail else size}:{tail.hex()}")
                os.replace(part, journal)
                rows.append((path, base, filled))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "base", "filled"])

    return run


def _write(root: str) -> Callable:
    """path, offset, data -> path, offset, size, digest: writes the bytes at their places; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            paths, offsets, data = (batch.column(k).to_pylist() for k in range(3))
            for path, offset, value in zip(paths, offsets, data, strict=True):
                file = os.open(_inside(root, path), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    while value:
                        done = os.pwrite(file, value, offset)
                        value, offset = value[done:], offset + done
                finally:
                    os.close(file)
            rest = [batch.column(k) for k in range(3, batch.num_columns)]
            sizes, digests = pa.array([len(v) for v in data], pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in data])
            yield pa.record_batch([batch.column(0), batch.column(1), sizes, digests, *rest], names=["path", "offset", "size", "digest", *batch.schema.names[3:]])

    return run


def _close(root: str) -> Callable:
    """path, end -> path: cuts what an older, longer tail left, and drops the journal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = _inside(root, path)
                os.truncate(target, end)
                if os.path.exists(target + JOURNAL):
                    os.remove(target + JOURNAL)
            yield pa.record_batch([batch.column(0)], names=["path"])

    return run


def append_texts(df: DataFrame, root: str, order: list[str], path: str = "path", text: str = "text", separator: str = "\n", headers: dict[str, str] | str | None = None, arrays: tuple[str, ...] = (), comma: str = ",", close: bool = True) -> DataFrame:
    """Appends the texts to the files root/path, in the order (columns that tell blocks of a file apart); returns what was written where.

    The table, which stays under root/.appends, has path, offset, size, digest (of the bytes, separator included) and the
    order's columns. Blocks are parted from what stands before them by the separator; a file that isn't there begins with
    its header instead (headers: by path, or the name of a column). arrays: paths that are JSON arrays, whose texts are
    elements, joined by the comma before the closing bracket; one that is no array begins anew. A null text is an empty block. close: without it the journals stay, as if the
    run had broken off.
    """
    spark = df.sparkSession
    os.makedirs(root, exist_ok=True)
    folder = os.path.join(root, ".appends", uuid.uuid4().hex)
    header = F.col(headers) if isinstance(headers, str) else F.lit("")
    for p, h in (headers.items() if isinstance(headers, dict) else ()):
        header = F.when(F.col(path) == p, h).otherwise(header)
    rows = df.select(F.col(path).alias("path"), *order, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(header, F.lit("")).alias("header"))
    dealt = rows.repartitionByRange("path", *order).sortWithinPartitions("path", *order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.select("path").distinct().mapInArrow(_open(root, set(arrays)), "path string, base long, filled boolean").write.parquet(f"{folder}/targets")
    targets = spark.read.parquet(f"{folder}/targets")
    array = F.col("path").isin(*arrays) if arrays else F.lit(False)
    within = Window.partitionBy("path", "part").orderBy(*order)
    ends = blocks.groupBy("path").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    own = blocks.join(ends, "path").join(targets, "path")
    own = own.withColumns({"n": F.row_number().over(within), "m": F.count(F.lit(1)).over(Window.partitionBy("path", "part"))})
    first, last = (F.col("n") == 1) & (F.col("part") == F.col("low")), (F.col("n") == F.col("m")) & (F.col("part") == F.col("high"))
    between = F.when(array, comma).otherwise(separator)
    opening = F.when(array & (F.col("base") == 0), "[").otherwise("")
    lead = F.when(first, F.concat(opening, F.when(F.col("filled") & ~(array & (F.col("base") == 0)), between).otherwise(F.when(array, "").otherwise(F.col("header"))))).otherwise(between)
    pieces = own.withColumn("data", F.concat(lead, "text", F.when(last & array, "]").otherwise("")).cast("binary")).withColumn("size", F.octet_length("data").cast("long"))
    sums = pieces.groupBy("path", "part").agg(F.sum("size").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).select("path", "part", "before")
    inner = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("inner", inner).join(starts, ["path", "part"]).withColumn("offset", F.col("base") + F.col("before") + F.col("inner"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = placed.select("path", "offset", "data", *order).mapInArrow(_write(root), "path string, offset long, size long, digest string, " + ", ".join(f"{c} {kinds[c]}" for c in order))
    out.write.parquet(f"{folder}/written")
    done = spark.read.parquet(f"{folder}/written")
    if close:
        done.groupBy("path").agg(F.max(F.col("offset") + F.col("size")).alias("end")).mapInArrow(_close(root), "path string").count()
    return done


def _check(root: str) -> Callable:
    """path, offset, size, digest -> and sound: whether these bytes still stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = []
            for path, offset, size, digest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                target = _inside(root, path)
                value = b""
                if os.path.exists(target):
                    with open(target, "rb") as file:
                        file.seek(offset)
                        value = file.read(size)
                sound.append(hashlib.sha256(value).hexdigest() == digest)
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(sound)], names=["path", "offset", "size", "sound"])

    return run


def _copy(root: str, tag: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source, size, to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                target = _inside(root, path)
                with open(target, "rb") as file:
                    out = os.open(f"{target}.{tag}", os.O_WRONLY | os.O_CREAT, 0o644)
                    try:
                        for at in range(0, size, COPY):
                            file.seek(source + at)
                            os.pwrite(out, file.read(min(COPY, size - at)), to + at)
                    finally:
                        os.close(out)
            yield pa.record_batch([batch.column(0)], names=["path"])

    return run


def _swap(root: str, tag: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = _inside(root, path)
                part = f"{target}.{tag}"
                if end == 0 and not os.path.exists(part):
                    with open(part, "wb"):
                        pass
                if os.path.exists(part):  # else an earlier try has done it
                    os.truncate(part, end)
                    os.replace(part, target)
            yield pa.record_batch([batch.column(0)], names=["path"])

    return run


def take_back(spark: SparkSession, root: str, blocks: DataFrame) -> DataFrame:
    """Takes blocks (path, offset, size, digest) out of their files again; returns path, offset, size, undone for each.

    A block whose bytes have changed stays, as do all others; what follows a cut moves up (see moved()). Files are copied by
    ranges of bytes, many tasks to a file, and swapped in whole.
    """
    tag = f"{uuid.uuid4().hex}.part"
    folder = os.path.join(root, ".appends", tag)
    blocks.select("path", "offset", "size", "digest").distinct().mapInArrow(_check(root), "path string, offset long, size long, sound boolean").write.parquet(f"{folder}/checked")
    checked = spark.read.parquet(f"{folder}/checked")
    cut = checked.filter("sound")
    w = Window.partitionBy("path").orderBy("offset")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([os.path.getsize(_inside(root, p)) for p in batch.column(0).to_pylist()], pa.int64())], names=["path", "total"])

    cut.select("path").distinct().mapInArrow(sizes, "path string, total long").write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    removed = cut.withColumns({"gone": F.sum("size").over(w), "from": F.col("offset") + F.col("size"), "until": F.lead("offset").over(w)}).join(totals, "path")
    behind = removed.select("path", F.col("from").alias("source"), (F.coalesce("until", "total") - F.col("from")).alias("size"), (F.col("from") - F.col("gone")).alias("to"))
    ahead = cut.groupBy("path").agg(F.min("offset").alias("size")).select("path", F.lit(0).cast("long").alias("source"), "size", F.lit(0).cast("long").alias("to"))
    kept = ahead.unionByName(behind).filter("size > 0")
    steps = kept.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(COPY).cast("long"))))
    ranges = steps.select("path", (F.col("source") + F.col("at")).alias("source"), F.least(F.lit(COPY).cast("long"), F.col("size") - F.col("at")).alias("size"), (F.col("to") + F.col("at")).alias("to"))
    ranges.repartition("path", "source").mapInArrow(_copy(root, tag), "path string").count()
    ended = cut.groupBy("path").agg(F.sum("size").alias("gone")).join(totals, "path").select("path", (F.col("total") - F.col("gone")).alias("end"))
    ended.mapInArrow(_swap(root, tag), "path string").count()
    return checked.withColumnRenamed("sound", "undone")


def moved(records: DataFrame, taken: DataFrame) -> DataFrame:
    """records (path, offset, ...) without the blocks that take_back() took, the others at their new offsets."""
    cut = taken.filter("undone").select("path", "offset", "size")
    rest = records.join(cut.select("path", "offset"), ["path", "offset"], "left_anti")
    shift = cut.select("path", F.col("offset").alias("__at"), F.col("size").alias("__size"))
    both = rest.select("path", F.col("offset").alias("__at"), F.lit(0).cast("long").alias("__size")).distinct().unionByName(shift)
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("path").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = both.withColumn("__before", before).filter("__size = 0").select("path", F.col("__at").alias("offset"), "__before")
    return rest.join(marks, ["path", "offset"]).withColumn("offset", F.col("offset") - F.col("__before")).select(*records.columns)
