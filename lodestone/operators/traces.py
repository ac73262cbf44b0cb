"""Traces of routing, intents and syncs as files: (path, text), one JSON object each, to be written by vault.write_texts()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders and names of the traces.
ROUTING, INTENT, SYNC = "90_system/traces/routing/{day}/", "90_system/traces/intent/", "90_system/traces/transcripts/{day}/transcript_sync_{run}.json"


def _json(**fields: Column) -> Column:
    """An object with the fields in their order, nulls included."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def routing_traces(df: DataFrame, day: str, run_id: str, ts: str, prompt_version: str = "", router_version: str = "") -> DataFrame:
    """(path, text) for routed captures: capture_id, model, prompt, answer (raw), label, confidence, next_actions, reasoning, parse_error (null for none).

    Columns that df lacks are null. A capture that no model was asked about (a null answer) has no trace; one that df
    repeats has one, of its largest answer.
    """
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("array<string>" if c == "next_actions" else "string")
    parsed = F.when(get("label").isNotNull(), F.struct(get("label").alias("route_label"), get("confidence").cast("double").alias("confidence"), get("next_actions").alias("next_actions"), get("reasoning").alias("reasoning")))
    errors = F.when(get("parse_error").isNull(), F.array().cast("array<string>")).otherwise(F.array(get("parse_error")))
    rows = df.filter(get("answer").isNotNull()).select("capture_id", F.struct(get("answer").alias("raw"), get("model").alias("model"), get("prompt").alias("prompt"), parsed.alias("parsed"), errors.alias("errors")).alias("t"))
    one = rows.groupBy("capture_id").agg(F.max("t").alias("t"))
    text = _json(capture_id=F.col("capture_id"), run_id=F.lit(run_id), ts=F.lit(ts), model=F.col("t.model"), prompt=F.col("t.prompt"), raw_response=F.col("t.raw"), parsed_result=F.col("t.parsed"), parse_errors=F.col("t.errors"), prompt_version=F.lit(prompt_version), router_version=F.lit(router_version))
    return one.select(F.concat(F.lit(ROUTING.format(day=day)), "capture_id", F.lit(f"_{run_id}.json")).alias("path"), text.alias("text"))


def intent_traces(df: DataFrame, run_id: str, ts: str, text: str = "text") -> DataFrame:
    """(path, text) for inputs whose intent a model was asked for: capture_id, text, prompt, answer. Without an id the first eight digits of the input's MD5 name the file; inputs of one name have one, the largest."""
    value = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.nullif("capture_id", F.lit("")), F.substring(F.md5(value.cast("binary")), 1, 8))
    trace = _json(timestamp=F.lit(ts), input=value, capture_id=F.col("capture_id"), run_id=F.lit(run_id), prompt=F.col("prompt"), raw_response=F.col("answer"))
    rows = df.select(F.concat(F.lit(INTENT), name, F.lit(f"_{run_id}.json")).alias("path"), trace.alias("text"))
    return rows.groupBy("path").agg(F.max("text").alias("text"))


def sync_trace(counts: dict[str, int], talks: DataFrame, run_id: str, day: str, began: str, ended: str, endpoint: str, params: dict[str, str], file_path: str, daily_note: bool = False) -> DataFrame:
    """One row (path, text): what a transcript sync did, its path from the run. counts: as sync_transcripts() returns them; talks: its conversations (id); began, ended: ISO times."""
    ids = talks.agg(F.array_sort(F.collect_set("id")).alias("ids"))  # a sync's own conversations, as many as one answer of the service has
    span = (F.unix_millis(F.lit(ended).cast("timestamp")) - F.unix_millis(F.lit(began).cast("timestamp"))).cast("long")
    request = F.struct(F.lit(endpoint).alias("endpoint"), F.from_json(F.to_json(F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv])) if params else F.lit("{}"), "map<string,string>").alias("params"))
    result = F.struct(F.lit(counts["segments_written"]).alias("segments_written"), F.lit(counts["segments_skipped"]).alias("segments_skipped"), F.lit(file_path).alias("file_path"))
    text = _json(run_id=F.lit(run_id), date=F.lit(day), timestamp=F.lit(ended), conversation_ids=F.col("ids"), segments_count=F.lit(counts["segments_written"] + counts["segments_skipped"]), api_request=request, api_response=F.struct(F.lit(counts["conversations"]).alias("conversations_count")), sync_result=result, daily_note_written=F.lit(daily_note), duration_ms=span)
    return ids.select(F.lit(SYNC.format(day=day, run=run_id)).alias("path"), text.alias("text"))
