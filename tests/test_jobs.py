"""Whole jobs on small folders: indexing, asking, ingesting; notes as texts."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conversations, notes
from lodestone.plans import jobs
from lodestone.operators import review
from lodestone.sources import inbox, logs, vault


def put(root, **files):
    for name, text in files.items():
        path = os.path.join(root, f"{name}.md")
        os.makedirs(root, exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)


def test_index_and_ask(spark, tmp_path):
    root, store = str(tmp_path / "vault"), str(tmp_path / "store")
    put(root, a="---\ndate: 2024-01-02\ntags: [x]\n---\n# A\nthe red fox lives here\n\nsee [[b]]\n", b="# B\nnothing of note\n", c="# C\nback to [[a]]\n")
    assert jobs.index_vault(spark, root, store) == {"new": 3}
    assert jobs.index_vault(spark, root, store) == {"unchanged": 3}
    answer = jobs.ask_vault(spark, store, "Red fox?", top_k=1).first().answer
    assert answer.startswith("Q: Red fox?") and "a.md" in answer and "b.md" in answer and "c.md" in answer
    os.utime(os.path.join(root, "b.md"), (2_000_000_000, 2_000_000_000))
    put(root, a="# A\na blue whale\n")
    os.remove(os.path.join(root, "c.md"))
    assert jobs.index_vault(spark, root, store) == {"touched": 1, "changed": 1, "deleted": 1}
    assert "whale" in jobs.ask_vault(spark, store, "blue whale", top_k=1).first().answer
    assert "fox" not in jobs.ask_vault(spark, store, "red fox", top_k=2).first().answer.split("Evidence")[1]


def test_snapshot():
    assert jobs.with_snapshot({"top_k": 1, "per_file_cap": 2}, {"top_k": "7", "per_file_cap": "x", "other": 1}) == {"top_k": 7, "per_file_cap": 2}
    assert jobs.with_snapshot({"top_k": 1}, None) == {"top_k": 1}


def test_conversations_are_written_once(spark, tmp_path):
    exports = spark.createDataFrame([('[{"id": "1", "title": "T", "create_time": 1, "messages": [{"role": "user", "content": "hi"}]}]',)], "value string")
    raw = conversations.normalise(conversations.export_conversations(exports))
    none = spark.createDataFrame([], "conversation_id string, content_hash string")
    first = jobs.ingest_conversations(raw, none)
    assert vault.write_texts(first.withColumn("path", F.concat("conversation_id", F.lit(".md"))), str(tmp_path / "out")) == 1
    assert "**User:** hi" in (tmp_path / "out" / "1.md").read_text()
    assert jobs.ingest_conversations(raw, first.select("conversation_id", "content_hash")).count() == 0


def test_frontmatter(spark):
    note = '---\na: 1\nsummary: x\n  y\nb: "q"\n---\nbody\n'
    df = spark.createDataFrame([(note,), ("no head",), (None,)], "t string")
    got = [r[0] for r in df.select(notes.update_frontmatter(F.coalesce("t", F.lit("")), {"summary": F.lit('n"e')})).collect()]
    assert got == ['---\na: 1\nb: "q"\nsummary: "n\\"e"\n---\nbody\n', '---\nsummary: "n\\"e"\n---\nno head', '---\nsummary: "n\\"e"\n---\n']
    assert df.select(notes.scalar_fields(notes.frontmatter(F.col("t")))).first()[0] == {"a": "1", "summary": "x", "b": "q"}


def test_tolerant_json(spark):
    cases = ['{"a": 1}', 'so: {"a": 1} ok', "```json\n{\"a\": 1}\n```", '{"a": 1', "{“a”: 1,}", "[1]", "", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(F.expr("1").alias("one"), notes.tolerant_json(F.col("t")).alias("v")).selectExpr("try_variant_get(v, '$.a', 'int')").collect()]
    assert got == [1, 1, 1, 1, 1, None, None, None]


def test_full_rebuild_and_settings(spark, tmp_path):
    root, store = str(tmp_path / "vault"), str(tmp_path / "store")
    put(root, a="# A\nthe red fox\n", b="# B\nthe red hen\n")
    jobs.index_vault(spark, root, store)
    put(root, a="# A\nthe red fox again\n")
    assert jobs.index_vault(spark, root, store) == {"changed": 1, "unchanged": 1}
    made = {r.rel_path: r.made for r in jobs.vault_tables(spark, store)["files"].collect()}
    assert made == {"a.md": 2, "b.md": 1} and os.listdir(f"{store}/chunks") != []
    assert sum(r.text.count("again") for r in jobs.vault_tables(spark, store)["chunks"].collect()) == 1
    assert jobs.vault_tables(spark, store)["chunks"].count() == 2
    jobs.index_vault(spark, root, store, most=6)  # other settings: all files are chunked anew
    assert {r.made for r in jobs.vault_tables(spark, store)["files"].collect()} == {3}
    assert jobs.vault_tables(spark, store)["chunks"].count() > 2
    assert jobs.index_vault(spark, root, store, full=True) == {"new": 2}
    assert sorted(x for x in os.listdir(f"{store}/chunks") if not x.startswith(".")) == ["made=4"] and jobs.vault_tables(spark, store)["chunks"].count() == 2
    with pytest.raises(ValueError, match="no strategy other"):
        jobs.index_vault(spark, root, store, strategy="other")


def talks(spark, *rows):
    """rows: id, start, segment ids."""
    made = [(i, datetime.fromisoformat(at), datetime.fromisoformat(at) + timedelta(minutes=5), [(s, "S1", f"text {s}", None) for s in segments]) for i, at, segments in rows]
    return spark.createDataFrame(made, "id string, started_at timestamp, finished_at timestamp, segments array<struct<segment_id:string,speaker_id:string,text:string,created_at:timestamp>>")


def test_sync_resumes_after_a_crash(spark, tmp_path):
    root, manifest = str(tmp_path / "notes"), str(tmp_path / "manifest")
    os.makedirs(root)
    rows = talks(spark, ("c1", "2024-01-01T10:00:00", ["a", "b"]), ("c2", "2024-01-02T10:00:00", ["c"]), ("c3", "2024-01-02T11:00:00", ["d"]), ("c4", "2024-01-03T09:00:00", ["e"]))
    with pytest.raises(jobs.InjectedCrash):
        jobs.sync_transcripts(spark, rows, root, manifest, "r1", "t1", crash_after=3)
    assert sorted(os.listdir(f"{root}/transcripts")) == ["2024-01-01.md", "2024-01-02.md"] and jobs.resume_from(spark, manifest, "transcripts") is None
    assert jobs.sync_transcripts(spark, rows, root, manifest, "r2", "t2") == {"segments_written": 1, "segments_skipped": 4, "days": 3, "conversations": 4}
    text = "".join((tmp_path / "notes" / "transcripts" / f"2024-01-0{k}.md").read_text() for k in (1, 2, 3))
    assert [text.count(f"segment_id: {s} ") for s in "abcde"] == [1] * 5
    assert jobs.resume_from(spark, manifest, "transcripts") == "2024-01-03T09:05:00Z"
    assert jobs.sync_transcripts(spark, rows, root, manifest, "r3", "t3")["segments_written"] == 0
    assert jobs.sync_transcripts(spark, rows.limit(0), root, manifest, "r4", "t4") == {"segments_written": 0, "segments_skipped": 0, "days": 0, "conversations": 0}


def test_exports_keep_their_places(spark, tmp_path):
    root, state = str(tmp_path / "notes"), str(tmp_path / "state")

    def raw(*rows):
        data = [{"id": i, "title": t, "create_time": 1700000000, "messages": [{"role": "user", "content": c}]} for i, t, c in rows]
        return conversations.normalise(conversations.export_conversations(spark.createDataFrame([(json.dumps(data),)], "value string")))

    first = raw(("1", "Day", "calm"), ("2", "Day", "Traceback (most recent call last)"), ("3", "Day", "calm too"))
    assert jobs.ingest_exports(spark, first, root, state) == {"conversations": 3, "written": 3, "unchanged": 0}
    paths = {r.conversation_id: r.note_path for r in spark.read.json(state).collect()}
    assert len(set(paths.values())) == 3 and paths["1"].endswith("/Day.md") and paths["3"].endswith("/Day_1.md")
    assert jobs.ingest_exports(spark, first, root, state) == {"conversations": 3, "written": 0, "unchanged": 3}
    assert jobs.ingest_exports(spark, raw(("1", "Other", "calmer"), ("4", "Day", "new")), root, state) == {"conversations": 2, "written": 2, "unchanged": 0}
    again = {r.conversation_id: r.note_path for r in spark.read.json(state).collect()}
    assert {k: again[k] for k in "123"} == paths and again["4"].endswith("/Day_2.md")
    os.rename(state, f"{state}.new")  # a run that broke off between the steps of the swap
    assert jobs.ingest_exports(spark, first.limit(0), root, state)["conversations"] == 0 and spark.read.json(state).count() == 4


def test_state_files(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"conversations": {"a": {"destination_vault": "d", "output_note_relpath": "p"}, "b": {"destination_vault": "", "output_note_relpath": "p"}}}))
    (tmp_path / "bad.json").write_text("{no")
    assert [tuple(r) for r in jobs.load_state(spark, str(good)).collect()] == [("a", "d", "p")]
    assert jobs.load_state(spark, str(tmp_path / "bad.json")).count() == jobs.load_state(spark, str(tmp_path / "none.json")).count() == 0


def test_metadata_workflow(spark):
    note = "---\ncontent_hash: h\n---\n# T\n\n## Transcript\n\nhello\n"
    answer = '{"signpost": "s", "summary": "x", "themes": ["t"], "open_questions": ["q"]}'
    rows = spark.createDataFrame([("a", note, answer), ("b", note, "no"), ("c", note, '{"signpost": ""}'), ("d", "---\na: 1\n---\n", answer), ("e", note, None), ("f", None, answer)], "path string, text string, answer string")
    got = {r.path: r for r in notes.metadata_workflow(rows, 2).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "generated", "b": "json_parse_failed", "c": "json_validation_failed", "d": "empty_transcript", "e": "waiting", "f": "empty_transcript"}
    assert 'signpost: "s"' in got["a"].text and got["a"].text.endswith("hello\n") and got["b"].text == note
    again = spark.createDataFrame([("a", got["a"].text, answer)], "path string, text string, answer string")
    assert notes.metadata_workflow(again, 2).first().status == "up_to_date" and notes.metadata_workflow(again, 3).first().status == "generated"
    assert {r.status for r in notes.metadata_workflow(rows, 2, enabled=False).collect()} == {"disabled"}
    assert notes.metadata_workflow(rows.filter("path = 'a'"), 2, provider=None).first().status == "no_provider"


def test_inbox(spark, tmp_path):
    day = tmp_path / "00_inbox" / "2024-01-02"
    taken = spark.createDataFrame([("capture_x.txt",), ("capture_x_2.txt",), ("n.md",)], "file_name string")
    texts = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", None)], "capture_id string, text string")
    made = inbox.ingest_texts(texts, "2024-01-02", "x", "T", taken)
    assert {r.capture_id: r.path for r in made.collect()} == {"c1": "00_inbox/2024-01-02/capture_x_1.txt", "c2": "00_inbox/2024-01-02/capture_x_3.txt", "c3": "00_inbox/2024-01-02/capture_x_4.txt"}
    files = inbox.ingest_files(spark.createDataFrame([("c4", "/home/n.md", "# n"), ("c5", "/home/raw", "r")], "capture_id string, original_path string, text string"), "2024-01-02", "T", taken)
    assert {r.capture_id: r.path.rsplit("/", 1)[1] for r in files.collect()} == {"c4": "n_1.md", "c5": "raw"}
    for df in (made, files):
        vault.write_texts(df, str(tmp_path))
        vault.write_texts(df.select(F.col("meta_path").alias("path"), F.col("meta").alias("text")), str(tmp_path))
    (day / "loose.txt").write_text("no sidecar")
    (day / "odd.txt").write_text("broken sidecar")
    (day / "odd.txt.meta.json").write_text("{")
    for k, name in enumerate(("capture_x_1.txt", "n_1.md", "capture_x_3.txt")):
        os.utime(day / name, (2_000_000_000 + k, 2_000_000_000 + k))
    rows = inbox.read_inbox(spark, str(day)).collect()
    assert {(r.capture_id, r.type, r.text) for r in rows} == {("c1", "text", "one"), ("c2", "text", "two"), ("c3", "text", ""), ("c4", "markdown", "# n"), ("c5", "other", "r")}
    assert {r.capture_id for r in inbox.read_inbox(spark, str(day), 2).collect()} == {"c2", "c4"}


def test_backfill(spark, tmp_path):
    root, log = str(tmp_path / "notes"), str(tmp_path / "log")
    put(root, **{f"n{k}": f"---\ncontent_hash: h{k}\n---\n## Transcript\n\nhello {k}\n" for k in range(5)}, none="---\na: b\n---\n")
    asked = []

    def answers(notes):
        asked.append(notes.count())
        return notes.withColumn("answer", F.when(F.col("path") == "n3.md", "no").otherwise('{"signpost": "s", "summary": "x", "themes": [], "open_questions": []}'))

    assert jobs.backfill_metadata(spark, root, answers, 1, log, "r", dry_run=True) == {"dry_run": 6} and asked == [0]
    assert jobs.backfill_metadata(spark, root, answers, 1, log, "r", limit=4, batch=2) == {"generated": 3, "json_parse_failed": 1}
    assert jobs.backfill_metadata(spark, root, answers, 1, log, "r") == {"up_to_date": 3, "json_parse_failed": 1, "generated": 1, "empty_transcript": 1} and asked[-1] == 2
    told = [r.payload for r in logs.read_jsonl(spark, log, logs.LEDGER, ["event_id"]).collect()]
    assert {(p["status"], p["processed"], p["total"]) for p in told} >= {("started", "0", "4"), ("running", "2", "4"), ("completed", "4", "4")}


def test_routed_and_distilled(spark, tmp_path):
    day = tmp_path / "10_derived" / "routed" / "2024-01-02"
    made = tmp_path / "10_derived" / "distill" / "2024-01-02"
    box = tmp_path / "00_inbox" / "2024-01-02"
    for folder in (day, made, box):
        folder.mkdir(parents=True)
    (box / "a b.txt").write_text("raw a")
    for k, raw in enumerate(("00_inbox/2024-01-02/a b.txt", "00_inbox/2024-01-02/gone.txt")):
        (day / f"{k}.json").write_text(json.dumps({"capture_id": f"c{k}", "route_label": "TASK", "raw_file_path": raw}))
        os.utime(day / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    (day / "broken.json").write_text("{")
    want = {("c0", "raw a"), ("c1", "")}
    assert {(r.capture_id, r.raw_text) for r in logs.read_routed(spark, str(tmp_path), "2024-01-02").collect()} == want
    assert {(r.capture_id, r.raw_text) for r in logs.read_routed(spark, str(tmp_path), "2024-01-02", 1).collect()} == {("c1", "")}
    (made / "d.json").write_text(json.dumps({"capture_id": "c0", "summary": "s", "confidence": 0.5, "tasks": [{"text": "t"}], "entities": [{"name": "N", "kind": "topic"}]}))
    (made / "e.json").write_text(json.dumps({"capture_id": "c1"}))
    rows = review.from_artifacts(logs.read_distilled(spark, str(tmp_path), "2024-01-02"), "2024-01-02").orderBy("capture_id", "ord").collect()
    assert [(r.capture_id, r.artifact_type, r.confidence) for r in rows] == [("c0", "note", 0.5), ("c0", "task", 0.45), ("c0", "entity", 0.4), ("c1", "note", 0.5)]
    assert rows[0].source_file == "10_derived/distill/2024-01-02/d.json" and len({r.proposal_id for r in rows}) == 4


def test_answers_in_pythons_notation(spark):
    """Dictionaries in single quotes, with what JSON lacks, and JSON that is itself a string; braces inside strings."""
    cases = {
        "{'a': 1}": 1, "so: {'a': 1, 'b': [True, None, (2, 3)],} ok": 1, "```python\n{'a': 1}\n```": 1, "{'a': 1, 'b': 'it\\'s {'}": 1, '{"a": 1, "b": "}{{"}': 1, json.dumps('{"a": 1}'): 1,
        "{'a': 1": None, "['a']": None, "{1, 2}": None, "{'a': f()}": None, "{'a': " * 50: None, "'a'": None, "{'a': b'x'}": None, "{": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(notes.tolerant_json(F.col("t")).alias("v")).selectExpr("try_variant_get(v, '$.a', 'int')").collect()]
    assert got == list(cases.values())
    nested = df.filter("k = 1").select(notes.tolerant_json(F.col("t")).alias("v")).selectExpr("to_json(v)").first()[0]
    assert json.loads(nested) == {"a": 1, "b": [True, None, [2, 3]]}


def test_backfill_reads_notes_once(spark, tmp_path, monkeypatch):
    root, log = str(tmp_path / "notes"), str(tmp_path / "log")
    put(root, **{f"n{k}": f"---\ncontent_hash: h{k}\n---\n## Transcript\n\nhello {k}\n" for k in range(5)})
    real, scans = vault.read_vault, []
    monkeypatch.setattr(jobs.vault, "read_vault", lambda *a, **k: scans.append(a) or real(*a, **k))
    seen = []

    def answers(notes):
        seen.append(sorted(r.path for r in notes.collect()))
        return notes.withColumn("answer", F.lit("no"))

    assert jobs.backfill_metadata(spark, root, answers, 1, log, "r", batch=2) == {"json_parse_failed": 5}
    assert len(scans) == 1 and seen == [["n0.md", "n1.md"], ["n2.md", "n3.md"], ["n4.md"]]
    assert jobs.backfill_metadata(spark, root, answers, 1, log, "r", limit=0) == {} and len(seen) == 3
