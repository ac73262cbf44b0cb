"""What the corpus operators share: the shared work folder, Arrow passes over texts, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker holds as Python objects at once; rows of an Arrow batch, unless the session says otherwise.
SLICE_BYTES, BATCH_ROWS = 4 << 20, 1_000


#: Folders of the tables of this process that are still there.
_WRITTEN: list[str] = []


@lru_cache(maxsize=1)
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of this process; any other has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_dir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    _WRITTEN.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def written_so_far() -> list[str]:
    """Folders of the tables of this process that are still there."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, folders: Iterable[str] | None = None, keep: Iterable[DataFrame] = ()) -> None:
    """Deletes tables that this process has written, all or those of the folders, but for those that `keep` reads. Results that were not saved yet need theirs."""
    kept = [f for df in keep for f in df.inputFiles()]
    for folder in list(_WRITTEN if folders is None else folders):
        if folder in _WRITTEN and not any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in kept):
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _WRITTEN.remove(folder)


def small_batches(spark: SparkSession) -> None:
    """Makes Arrow batches of whole texts fit an executor's memory, where the session still has Spark's own default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """At the end of a task: workers are reused, so what it held goes back to the machine and not to the worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = sum(c.nbytes for c in batch.columns)
        step = n if total <= most else max(1, n * most // total)
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def texts(column: pa.Array) -> list[str]:
    """The column's texts; null is empty."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def text_pass(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """One Arrow pass over the given columns. make() runs once in each task and returns what maps a slice, of about `most` bytes, to columns by name."""
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, most):
            out = work(part)
            yield pa.record_batch([pa.array(out[n], type=arrow.field(n).type) if not isinstance(out[n], pa.Array) else out[n].cast(arrow.field(n).type) for n in names], schema=arrow)
        del work
        give_back()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """rows with the columns of table, which has one row for each key and, in column n, how many of the rows have it.

    Keys that more than a thousandth of all rows have, so less than a thousand keys whatever the data, are broadcast; the
    rest meet by a shuffle in which no key has more than a thousandth of the rows. total: the sum of n, if it is known.
    """
    if total is None:
        total = table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    hot = table.filter(F.col(n) * 1_000 > total)
    often = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(n) * 1_000 <= total), key)
    return often.unionByName(rest)


def text_udf(kind: str, make: Callable[[], Callable[..., list]]):
    """A pandas UDF of one value for each row: make() runs once in each task and returns what maps whole columns to a list of values."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        work = make()
        for part in parts:
            values = work(*part) if isinstance(part, tuple) else work(part)
            yield pd.Series(values, dtype=None if kind == "double" else object)
        del work
        give_back()

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(v, label) for each end of an edge: label is the smallest end that can be reached.

    Rounds of smallest neighbouring label and pointer jumping; each round is a table in the shared folder, so a lost
    executor costs one round at most. Neighbours are only aggregated (min, combined before the shuffle), never listed; the
    labels of hubs, ends of more than a thousandth of all edges, are broadcast.
    An edge with a null end is ignored; no edges give no rows. Raises if max_rounds do not suffice.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    ends = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    labels = written(ends.select(F.col("a").alias("v"), F.least("a", "m").alias("label"), "n"), "labels0")
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    for k in range(1, max_rounds + 1):
        near = look_up(both.select("a", F.col("b").alias("v")), labels, "v", total=total).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.v == near.a, "left").select("v", "label", "n", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("far"))
        after = step.join(jump, step.next == jump.w, "left").select("v", "n", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        after = written(after, f"labels{k}")
        labels = after.select("v", "label", "n")
        if not after.filter("moved").take(1):
            return labels.select("v", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
