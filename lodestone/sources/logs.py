"""JSON lines and JSON artifacts; broken rows are left out, never fatal."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vault import read_files

LEDGER = "event_id string, run_id string, ts timestamp, event_type string, capture_id string, payload map<string,string>"
MANIFEST = "schema_version int, source string, run_id string, run_type string, window_start string, window_end string, counts struct<discovered:int,ingested:int,skipped:int,errored:int>, last_successful_item_timestamp string, errors array<struct<item_id:string,error:string>>, app_version string, git_sha string, created_at string"
QUEUE = "proposal struct<proposal_id:string,capture_id:string,run_id:string,artifact_type:string,title:string,content:string,destination:string,rationale:string,confidence:double,created_at:string,source_file:string>, status string, status_changed_at string, defer_count int"
ROUTED = "capture_id string, route_label string, confidence double, next_actions array<string>, reasoning string, routed_at string, raw_file_path string, meta_file_path string"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a JSON-lines table that parse and have all required fields."""
    lines = spark.read.text(path)
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.dropna(subset=required)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines in the order of files and of lines within them; numbers grow but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_artifacts(spark: SparkSession, path: str, schema: str, key: str, newest: int | None = None) -> DataFrame:
    """One JSON object per file under date folders, with its date and file; the newest files only, if asked."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time")}).filter(F.col(key).isNotNull())
    rows = rows.withColumn("date", F.regexp_extract("file", r"/(\d{4}-\d{2}-\d{2})/", 1))
    return rows.orderBy(F.desc("modified"), "file").limit(newest) if newest else rows


def with_raw_text(items: DataFrame, texts: DataFrame, path: str = "raw_file_path") -> DataFrame:
    """items with raw_text by path; a missing file gives an empty text. texts: path, value."""
    return items.join(texts.select(F.col("path").alias(path), F.col("value").alias("raw_text")), path, "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


DISTILLED = "capture_id string, distilled_at string, route_label string, summary string, key_points array<string>, tasks array<struct<text:string,priority:string,due_date:string>>, entities array<struct<name:string,kind:string,note:string>>, confidence double"


def read_routed(spark: SparkSession, root: str, day: str, limit: int | None = None) -> DataFrame:
    """The routed items of a day, the newest first and at most `limit`, with the raw text of each; a raw file that is gone gives an empty one.

    With a limit only the files that these items name are read, else all below the inbox.
    """
    items = read_artifacts(spark, f"{root}/10_derived/routed/{day}", ROUTED, "capture_id", limit)
    if limit:
        items = items.cache()
        names = [r.raw_file_path for r in items.select("raw_file_path").distinct().collect() if r.raw_file_path]
        there = [f"{root}/{n}" for n in names if os.path.exists(f"{root}/{n}")] if os.path.isdir(root) else [f"{root}/{n}" for n in names]
        files = spark.read.format("binaryFile").load(there) if there else spark.createDataFrame([], "path string, content binary")
    else:
        files = read_files(spark, f"{root}/00_inbox")
    base = "/" + root.split("://")[-1].lstrip("/").rstrip("/")
    path = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    texts = files.select(F.substring(path, F.lit(len(base) + 2), F.length(path)).alias("path"), F.decode("content", "UTF-8").alias("value"))
    return with_raw_text(items, texts)


def read_distilled(spark: SparkSession, root: str, day: str) -> DataFrame:
    """The distilled artifacts of a day, as review.from_artifacts() takes them; files that don't parse are left out."""
    return read_artifacts(spark, f"{root}/10_derived/distill/{day}", DISTILLED, "capture_id").withColumn("file", F.regexp_extract("file", r"(10_derived/.*)$", 1))


def append_events(events: DataFrame, path: str, run_id: str) -> None:
    """Appends (event_type, capture_id, payload) as ledger lines with fresh ids and the time of the run."""
    rows = events.select(F.expr("uuid()").alias("event_id"), F.lit(run_id).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "event_type", "capture_id", "payload")
    rows.write.mode("append").json(path)
