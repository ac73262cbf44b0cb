"""Structured Streaming: idempotent ingestion into a keyed table, event windows with late data, tails of growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Growing folder of JSON lines; broken lines are dropped."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def ingest_new(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends the rows whose keys the table doesn't have yet, each once, however often a batch or a source file is repeated.

    A batch that is replayed after a crash writes its own folder anew (stream=<id in the checkpoint>/batch=<number>), so
    nothing appears twice; a stream with another checkpoint counts its batches anew and has folders of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        own = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id").alias("id")).first().id
        try:
            known = spark.read.parquet(table_path).filter((F.col("stream") != own) | (F.col("batch") != number))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table_path}/stream={own}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events of each type in each window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def event_sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "run_id") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def distinct_stream(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once as far as the watermark remembers."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
