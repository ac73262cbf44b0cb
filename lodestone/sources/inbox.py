"""The inbox: raw captures with a JSON sidecar beside each, as a table, and captures to be put there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_type, file_title
from ..operators.ledger import free_names
from .vault import read_files

META = ".meta.json"
SIDECAR = "id string, created_at string, source string, type string, files array<string>, origin map<string,string>"


def read_inbox(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(name, capture_id, type, text, modified) of the folder's raw files, the newest first, at most `limit` of them; files without a readable sidecar are left out after that."""
    files = read_files(spark, folder, recursive=False).withColumn("name", F.url_decode(F.replace(F.regexp_extract("path", "[^/]*$", 0), F.lit("+"), F.lit("%2B"))))
    raw = files.filter(~F.col("name").endswith(META)).select("name", F.col("modificationTime").alias("modified"), "content")
    raw = raw.orderBy(F.desc("modified"), "name").limit(limit) if limit else raw
    meta = files.filter(F.col("name").endswith(META)).select(F.expr(f"substring(name, 1, length(name) - {len(META)})").alias("name"), F.from_json(F.decode("content", "UTF-8"), SIDECAR).alias("m"))
    return raw.join(meta.filter("m.id is not null"), "name").select("name", F.col("m.id").alias("capture_id"), "m.type", F.decode("content", "UTF-8").alias("text"), "modified")


def _put(rows: DataFrame, name: Column, extension: Column, kind: Column, source: str, origin: Column, day: str, ts: str, taken: DataFrame) -> DataFrame:
    rows = rows.withColumns({"__base": name, "__ext": extension})
    rows = free_names(rows, "__base", "__ext", taken, ["capture_id"])
    raw = F.concat(F.lit(f"00_inbox/{day}/"), "file_name")
    meta = F.to_json(F.struct(F.col("capture_id").alias("id"), F.lit(ts).alias("created_at"), F.lit(source).alias("source"), kind.alias("type"), F.array("file_name").alias("files"), origin.alias("origin")))
    payload = F.create_map(F.lit("source"), F.lit(source), F.lit("raw_path"), raw, F.lit("meta_path"), F.concat(raw, F.lit(META)), F.lit("date"), F.lit(day))
    return rows.select("capture_id", raw.alias("path"), "text", F.concat(raw, F.lit(META)).alias("meta_path"), meta.alias("meta"), F.lit("CAPTURE_INGESTED").alias("event_type"), payload.alias("payload"))


def ingest_texts(texts: DataFrame, day: str, stamp: str, ts: str, taken: DataFrame) -> DataFrame:
    """(capture_id, path, text, meta_path, meta, event_type, payload): texts (capture_id, text) as files named by the time stamp, with sidecars and ledger events.

    taken: file_name of the day's folder as it is; a name that is in use gets the next free suffix, by capture_id.
    """
    return _put(texts, F.lit(f"capture_{stamp}"), F.lit(".txt"), F.lit("text"), "cli_text", F.create_map(F.lit("command"), F.lit("capture --text")), day, ts, taken)


def ingest_files(files: DataFrame, day: str, ts: str, taken: DataFrame) -> DataFrame:
    """The same for files (capture_id, original_path, text), which keep their names and whose type their extension tells."""
    name = F.regexp_extract("original_path", "[^/]*$", 0)
    extension = F.regexp_extract(name, r"\.[^./]+$", 0)
    origin = F.create_map(F.lit("command"), F.lit("capture --file"), F.lit("original_path"), F.col("original_path"))
    return _put(files, file_title(name), extension, content_type(name), "cli_file", origin, day, ts, taken)
