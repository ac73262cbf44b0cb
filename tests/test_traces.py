"""Traces of routing, intents and syncs."""

from __future__ import annotations

import json

from lodestone.operators import classify, traces


def test_routing_and_intent_traces(spark):
    rows = spark.createDataFrame([("c1", '{"route_label": "idea", "confidence": 0.8, "next_actions": ["a"], "reasoning": "r"}'), ("c2", None), ("c3", "no json")], "capture_id string, answer string")
    made = {r.path: json.loads(r.text) for r in traces.routing_traces(classify.coerce_route(rows), "2024-01-02", "run", "t", "p1").collect()}
    assert sorted(made) == [f"90_system/traces/routing/2024-01-02/{c}_run.json" for c in ("c1", "c3")]
    first = made["90_system/traces/routing/2024-01-02/c1_run.json"]
    assert first["parsed_result"]["route_label"] and first["parsed_result"]["confidence"] == 0.8 and first["parse_errors"] == [] and first["prompt_version"] == "p1" and first["model"] is None and first["run_id"] == "run"
    asked = spark.createDataFrame([("c1", "hello", "p", "a"), (None, "hello", "p", "a"), (None, "hello", "p", "b"), ("", None, None, None)], "capture_id string, text string, prompt string, answer string")
    made = {r.path: json.loads(r.text) for r in traces.intent_traces(asked, "run", "t").collect()}
    assert sorted(p.rsplit("/", 1)[1] for p in made) == ["5d41402a_run.json", "c1_run.json", "d41d8cd9_run.json"]
    assert made["90_system/traces/intent/5d41402a_run.json"]["raw_response"] == "b" and made["90_system/traces/intent/d41d8cd9_run.json"]["input"] == ""


def test_sync_trace(spark):
    talks = spark.createDataFrame([("c2",), ("c1",)], "id string")
    counts = {"segments_written": 3, "segments_skipped": 1, "days": 1, "conversations": 2}
    row = traces.sync_trace(counts, talks, "run", "2024-01-02", "2024-01-02T10:00:00Z", "2024-01-02T10:00:02.500Z", "https://x", {"limit": "100"}, "transcripts/2024-01-02.md", True).first()
    found = json.loads(row.text)
    assert row.path == "90_system/traces/transcripts/2024-01-02/transcript_sync_run.json" and found["conversation_ids"] == ["c1", "c2"] and found["segments_count"] == 4
    assert found["api_request"] == {"endpoint": "https://x", "params": {"limit": "100"}} and found["duration_ms"] == 2500 and found["daily_note_written"] is True
