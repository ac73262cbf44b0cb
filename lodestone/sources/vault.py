"""A folder of notes as a table, and tables of texts as folders of notes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import by_bytes
from ..functions.text import file_title


MARK = ".mark-"


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression of the whole path; a star also stands for slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def _odd_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of the given paths as binaryFile reads others."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            stat = os.stat(path)
            with open(path, "rb") as file:
                yield pa.record_batch([pa.array([f"file:{quote(path)}"]), pa.array([stat.st_mtime_ns // 1_000_000 * 1_000], pa.timestamp("us", "UTC")), pa.array([stat.st_size], pa.int64()), pa.array([file.read()], pa.binary())], names=["path", "modificationTime", "length", "content"])


def read_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the folder's files.

    Spark's own reader passes over empty files and names that begin with a dot or underscore. In a folder on a file system that
    the driver sees, such files are listed here (names alone) and read by tasks, so they count too; elsewhere they do not.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    local = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))
    if "://" in root.removeprefix("file://") or not os.path.isdir(local):
        return files
    odd = []
    for folder, folders, names in os.walk(local):
        if not recursive:
            folders.clear()
        hidden = any(part[:1] in "._" for part in os.path.relpath(folder, local).split(os.sep) if part not in (".", ""))
        for name in names:
            path = os.path.join(folder, name)
            if fnmatchcase(name, pattern) and (hidden or name[:1] in "._" or not os.path.getsize(path)) and not name.startswith(MARK) and not name.endswith(".crc"):
                odd.append((path,))
    if not odd:
        return files
    schema = "path string, modificationTime timestamp, length long, content binary"
    return files.unionByName(spark.createDataFrame(odd, "path string").repartition(max(1, len(odd) // 100)).mapInArrow(_odd_files, schema))


def read_vault(spark: SparkSession, root: str, exclude: list[str] | None = None, pattern: str = "*.md") -> DataFrame:
    """(rel_path, title, mtime_ns, size_bytes, content, content_hash) of the folder's files, whole and in all folders below; see read_files()."""
    files = read_files(spark, root, pattern)
    base = "/" + root.split("://")[-1].lstrip("/").rstrip("/")
    path = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    rows = files.withColumn("rel_path", F.substring(path, F.lit(len(base) + 2), F.length(path)))
    rows = rows.filter(~excluded(F.col("rel_path"), exclude or []))
    return rows.select("rel_path", file_title(F.col("rel_path")).alias("title"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("content_hash"))


def write_texts(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Writes each row's text to root/path by a temporary name and a rename; returns the number of files.

    root is a folder that all executors share: a task that doesn't see the driver's mark there fails, as does a path with
    two different texts. Rows that repeat path and text are one file; null is an empty text.
    """
    os.makedirs(root, exist_ok=True)
    mark = os.path.join(root, f"{MARK}{uuid.uuid4().hex}")
    with open(mark, "w", encoding="utf-8"):
        pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in by_bytes(batches):
            if not os.path.exists(mark):
                raise OSError(f"{root} is not a folder that this executor shares with the driver")
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.normpath(os.path.join(root, p))
                if not target.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"{p} leaves the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8", newline="") as out:
                    out.write(t or "")
                os.replace(part, target)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.groupBy(path).agg(F.max(value).alias("most"), F.min(value).alias("least"))
    one = F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(F.raise_error(F.concat(F.lit("several texts for "), path)))
    try:
        return rows.select(path, one.alias(text)).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    finally:
        os.remove(mark)
