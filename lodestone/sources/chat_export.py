"""Chat-export archives: the likeliest conversations file of each ZIP, without unpacking the others."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversations import export_conversations, normalise

# What a file name's words are worth.
POINTS = (("conversations", 100), ("message", 50), ("chat", 40))


def member_score(name: str, has_chat_page: bool) -> int:
    low = name.lower()
    score = sum(points for word, points in POINTS if word in low) + low.endswith(".json")
    return score + 10 * (has_chat_page and "message" in low)


def pick_member(archive: zipfile.ZipFile) -> zipfile.ZipInfo | None:
    """Of the JSON files the one with the most points, of these the largest, of these the first."""
    files = [i for i in archive.infolist() if not i.is_dir()]
    page = any(i.filename.lower().endswith("chat.html") for i in files)
    return max((i for i in files if i.filename.lower().endswith(".json")), key=lambda i: (member_score(i.filename, page), i.file_size), default=None)


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member := pick_member(archive):
                        out.append({"path": path, "member": member.filename, "value": archive.read(member).decode("utf-8", "replace")})
            except zipfile.BadZipFile:
                continue
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("value", pa.string())]))


def read_exports(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """(path, member, value) of the ZIP files under path; broken ones give nothing. newest: only so many, by time of change."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    files = files.orderBy(F.desc("modificationTime"), "path").limit(newest) if newest else files
    return files.select("path", "content").mapInArrow(_unzip, "path string, member string, value string")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return normalise(export_conversations(read_exports(spark, path)))
