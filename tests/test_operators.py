"""Behaviour on small tables written for the purpose: edges, ties, nulls, empty input."""

from __future__ import annotations

import hashlib
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions import text, vectors
from lodestone.functions.ranking import row_numbers
from lodestone.operators import ask, classify, conversations, distill, index, ledger, markdown, review, search
from lodestone.operators.textindex import TextIndex
from lodestone.sources import chat_export, logs, transcripts, vault
from lodestone.streaming import incremental

NOTE = "---\ndate: 03-09-2024\ntags: [\"alpha\", '#beta']\n---\n# Überschrift ##\nsee [[Other Note#part|shown]] and `[[not this]]` #tag1\n\n```\n# no heading\n[[no link]]\n```\n## Sub\nlast (#x/y)\n"


def one(df):
    return [tuple(r) for r in df.collect()]


def column(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_markdown_parse():
    found = markdown.parse(NOTE.encode())
    raw = NOTE.encode()
    assert found["journal_date"] == "2024-03-09"
    assert found["fm_tags"] == ["alpha", "beta"]
    assert [(h["level"], h["text"]) for h in found["headings"]] == [(1, "Überschrift"), (2, "Sub")]
    assert raw[found["headings"][0]["start_byte"] : found["headings"][0]["end_byte"]].decode() == "# Überschrift ##"
    assert [(x["target"], x["section"], x["alias"]) for x in found["outlinks"]] == [("Other Note", "part", "shown")]
    assert raw[found["outlinks"][0]["start_byte"] : found["outlinks"][0]["end_byte"]].decode() == found["outlinks"][0]["raw"]
    assert found["inline_tags"] == ["tag1", "x/y"]


@pytest.mark.parametrize("content", ["", "---\nopen", "[[#only]] text", "no ` end [[a]]", "```\n# x"])
def test_markdown_edges(content):
    found = markdown.parse(content.encode())
    assert found["headings"] == [] and found["outlinks"] == [] and found["fm_tags"] == []


def test_bad_date_is_null():
    assert markdown.parse(b"---\ndate: 2024/01/02\n---\n")["journal_date"] is None


def test_yaml_list_tags():
    assert markdown.parse(b"---\ntags:\n- b\n- '#a'\nother: 1\n---\n")["fm_tags"] == ["a", "b"]


def test_chunks_cover_sections_at_characters():
    body = ("# A\n" + "é" * 5000 + "\n\nsecond\n").encode()
    chunks = markdown.plan_chunks(body, markdown.parse(body)["headings"], "a.md", "m", 200)
    assert all(c["end_byte"] - c["start_byte"] <= 200 for c in chunks)
    assert "".join(c["text"] for c in chunks) == body.decode()
    assert markdown.plan_chunks(b"no headings", [], "a.md", "m") == []
    two = markdown.plan_chunks(b"# H\none\n\ntwo", markdown.parse(b"# H\none\n\ntwo")["headings"], "a.md", "m")
    assert [c["text"] for c in two] == ["# H\none\n\n", "two"]


def test_breadcrumbs():
    heads = [{"level": n, "text": t} for n, t in ((1, "a"), (3, "b"), (2, "c"), (1, "d"))]
    assert markdown.breadcrumbs(heads) == ["H1 a", "H1 a > H3 b", "H1 a > H2 c", "H1 d"]


def test_tokens_and_phrases(spark):
    assert column(spark, ["naïve Straße co-op foo_bar don't", "", None], text.tokens) == [" naive straße co op foo bar don t ", "  ", "  "]
    assert text.query_tokens("Don't, naïve!") == ["don", "t", "naive"] and text.query_tokens(" ?! ") == []
    count = lambda phrase: lambda c: text.phrase_count(text.tokens(c), phrase)
    assert column(spark, ["a a a b", "b", None], count(["a", "a"])) == [2, 0, 0]
    assert column(spark, ["a a a b", "a-b"], count([])) == [0, 0]
    assert column(spark, ["x y", "", None], lambda c: text.token_count(text.tokens(c))) == [2, 0, 0]


def test_excerpt_lengths(spark):
    got = column(spark, ["x" * 50 + "needle" + "y" * 50, "short", None], lambda c: text.excerpt(c, "NEEDLE", 20, 5, 5))
    assert got[0].startswith("…") and got[0].endswith("…") and len(got[0]) == 22 and "needle" in got[0]
    assert got[1:] == ["short", ""]


def test_dates_and_titles(spark):
    assert column(spark, ["2024-1-5", "'01-06-2024'", "2024/01/02", "x", None], text.try_date) == ["2024-01-05", "2024-01-06", None, None, None]
    assert column(spark, ["a/journal/x.md", "n/2024-01-02.md", "n/x.md"], text.note_type) == ["journal", "journal", "evergreen"]
    assert column(spark, ["Größe: <x> a_b", "???", None], lambda c: text.safe_title(c, F.lit("none"))) == ["Größe x a_b", "none", "none"]


def test_vectors_round_trip(spark):
    made = vectors.hash_embed("hé", 20)
    got = spark.createDataFrame([("hé",)], "v string").select(vectors.hash_embedding(F.col("v"), 20)).first()[0]
    assert got == pytest.approx(made, abs=1e-12) and all(-1 <= x <= 1 for x in made)
    assert vectors.from_bytes(vectors.to_bytes([0.5, -1.0])) == [0.5, -1.0]
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 3), (2, [1.0, 1.0], 0)], "k int, v array<float>, w int")
    assert [(r.k, r.mean) for r in vectors.weighted_mean(rows, ["k"], "v", "w").collect()] == [(1, [0.25, 0.75])]


def test_zero_norms_are_skipped(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "file_id int, vector array<float>")
    assert [r.file_id for r in search.cosine_topk(rows, [1.0, 0.0], 5).collect()] == [2, 3]
    assert search.cosine_topk(rows, [0.0, 0.0], 5).count() == 0


def test_tags(spark):
    rows = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha"), (3, "beta")], "file_id int, name string")
    ids = lambda tags, every: sorted(r.file_id for r in search.with_tags(rows, tags, every).collect())
    assert ids(["alpha", "#beta"], True) == [3] and ids(["alpha", "beta", "beta"], False) == [1, 2, 3] and ids(["none"], True) == []


def hits(spark, rows):
    full = [(s, p, "t", "h", a, b, d, 0, "x" * n, False) for s, p, a, b, d, n in rows]
    return spark.createDataFrame(full, "score double, rel_path string, title string, heading_path string, start_byte long, end_byte long, effective_date string, mtime_ns long, excerpt string, expanded_context boolean")


def test_temporal_modes(spark):
    two = hits(spark, [(0.6, "n/values.md", 0, 1, "2024-01-02", 1), (0.6, "v/journal/2024-01-02.md", 0, 1, "2024-01-02", 1)])
    assert [r.rel_path for r in ask.temporal(two, "hybrid").orderBy("rank").collect()][0].startswith("v/journal")
    old = hits(spark, [(0.9, "n/a.md", 0, 1, "2023-11-01", 1), (0.1, "n/b.md", 0, 1, "2024-01-02", 1)])
    assert [r.rel_path for r in ask.temporal(old, "recent").collect()] == ["n/b.md"]
    everything = ask.temporal(old, "all").orderBy("rank").collect()
    assert [r.rel_path for r in everything] == ["n/a.md", "n/b.md"] and {r.boost for r in everything} == {0.0}


def test_rerank_and_pack(spark):
    rows = ask.temporal(hits(spark, [(0.9, "a", 0, 1, "2024-01-01", 50), (0.8, "a", 0, 1, "2024-01-01", 50), (0.7, "a", 1, 2, "2024-01-01", 50), (0.6, "b", 0, 1, "2024-01-01", 50)]), "all")
    assert [(r.rel_path, r.start_byte) for r in ask.rerank(rows, 1).orderBy("rank").collect()] == [("a", 0), ("b", 0)]
    assert ask.rerank(rows, 0).count() == 3
    cost = 50 + 1 + 1 + 64
    assert ask.pack(rows, 10_000).count() == 4 and ask.pack(rows, cost + 10).count() == 1 and ask.pack(rows, 10).count() == 0
    assert ask.pack(rows, cost).count() == 4  # a budget used up exactly ends nothing
    assert "No matches" in ask.answer(rows.limit(0), "q").first().answer


def test_routes(spark):
    texts = ["I need to finish the report. It must ship.", "idea", "hi", "the sky", "", None, "todo met with"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.label, r.confidence) for r in classify.route_by_rules(df).collect()}
    assert got == {0: ("TASK", 0.9), 1: ("UNKNOWN", 0.1), 2: ("UNKNOWN", 0.1), 3: ("UNKNOWN", 0.3), 4: ("UNKNOWN", 0.1), 5: ("UNKNOWN", 0.1), 6: ("TASK", 0.5)}
    first = classify.route_by_rules(df).filter("id = 0").first()
    assert first.next_actions == ["finish the report", "ship"]
    engines = {r.id: r.engine for r in classify.route_hybrid(df, threshold=0.9).collect()}
    assert engines[0] == "rule" and engines[3] == "model"
    assert {r.engine for r in classify.route_hybrid(df, force_model=True).collect()} == {"model"}


def test_intents(spark):
    cases = {"todo: buy milk": "task_generation", "Should I move?": "decision_support", "please run it": "execution", "I feel fine": "reflect", "remember that": "knowledge_update", "lol": "ignore", "something else": "reflect"}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.intent for r in classify.intent(df).collect()} == cases


def test_destinations(spark):
    rows = [(1, "fix it", "python error", 6, 20.0), (2, "diary", "a quiet day", 2, 300.0), (3, "x", "```a``` b ```c```", 1, 9.0), (4, None, "Traceback (most recent call last)", 1, 9.0)]
    df = spark.createDataFrame(rows, "conv_id int, title string, text string, n_messages int, mean_chars double")
    assert {r.conv_id: r.destination for r in classify.destination(df).collect()} == {1: "tooling", 2: "daemon", 3: "tooling", 4: "tooling"}
    assert {r.destination for r in classify.destination(df, "force-daemon").collect()} == {"daemon"}


def test_distill(spark):
    value = "Met Alice about it! We must call Bob.,\nurgent: need to pay the bill;\nok"
    df = spark.createDataFrame([("a", value), ("b", None), ("c", "")], "capture_id string, text string")
    got = {r.capture_id: (r.s, r.k, [tuple(t) for t in r.t]) for r in df.select("capture_id", distill.summary(F.col("text")).alias("s"), distill.key_points(F.col("text")).alias("k"), distill.tasks(F.col("text")).alias("t")).collect()}
    assert got["b"] == got["c"] == ("Empty capture.", [], [])
    assert got["a"][0] == "Met Alice about it! We must call Bob."
    assert got["a"][2] == [("call Bob", "med"), ("pay the bill", "high")]
    people = [(r.name, r.kind) for r in distill.entities(df).orderBy("ord").collect()]
    assert people == [("Met", "TOPIC"), ("Alice", "PERSON"), ("Bob", "PERSON")]


def test_new_tasks_and_entities(spark):
    found = spark.createDataFrame([("pay rent",), ("sleep",)], "text string")
    todo = spark.createDataFrame([("- [ ] pay rent now",)], "todo string")
    assert one(distill.new_tasks(found, todo)) == one(distill.new_tasks(found, todo, gram=2)) == [("sleep",)]
    odd = spark.createDataFrame([("",), (None,), ("pay rent now",), ("rent",), ("rent nov",), ("now",)], "text string")
    assert sorted(map(str, one(distill.new_tasks(odd, todo, gram=3)))) == sorted(map(str, one(distill.new_tasks(odd, todo)))) == ["('rent nov',)", "(None,)"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(12))) for _ in range(60)]
    want = sorted((t,) for t in texts[:40] if not any(t in x for x in texts[40:]))
    assert sorted(one(distill.new_tasks(spark.createDataFrame([(t,) for t in texts[:40]], "text string"), spark.createDataFrame([(t,) for t in texts[40:]], "todo string"), gram=3))) == want
    e = spark.createDataFrame([(1, "Ann", "P"), (2, "ann", "P"), (3, "Bo", "P")], "i int, name string, kind string")
    assert one(distill.new_entities(e, e.filter("i = 3").select("name", "kind"), ["i"]).select("i")) == [(1,)]


def test_salience(spark):
    lines = "".join(f"Decision {k}: we go on with it\n" for k in range(200))
    df = spark.createDataFrame([("a", lines), ("b", "short"), ("c", None)], "id string, text string")
    got = {r.id: r.salience for r in distill.salience_input(df, 500).collect()}
    assert 0 < len(got["a"]) <= 500 and got["b"] == "short" and got["c"] == ""


def test_undo(spark):
    block = "<!-- block:w1 begin -->\n- one\n<!-- block:w1 close -->".replace("close", "end") + "\n\n"
    notes = spark.createDataFrame([("n.md", "top\n" + block + "rest\n"), ("m.md", "<!-- block:w2 begin -->\nedited\n<!-- block:w2 end -->\n"), ("e/entities.json", "[]"), ("x.md", "none")], "path string, text string")
    records = spark.createDataFrame([("w1", "n.md", hashlib.sha256(block.encode()).hexdigest()), ("w2", "m.md", "0"), ("w3", "gone.md", "0"), ("w4", "e/entities.json", "0"), ("w5", "x.md", None)], "write_id string, path string, content_hash string")
    after, told = distill.undo(notes, records)
    assert {r.write_id: r.status for r in told.collect()} == {"w1": "undone", "w2": "modified", "w3": "missing_file", "w4": "skipped", "w5": "missing_block"}
    assert {r.path: r.text for r in after.collect()} == {"n.md": "toprest\n", "m.md": "<!-- block:w2 begin -->\nedited\n<!-- block:w2 end -->\n", "e/entities.json": "[]", "x.md": "none"}


def test_lines(spark):
    texts = [None, "", "a", "é\n\n漢 b\n", "\n"]
    rows = model.split_lines(spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")).collect()
    want = []
    for k, t in enumerate(texts):
        at = chars = 0
        for n, x in enumerate((t or "").split("\n")):
            want.append((k, n, x, at, at + len(x.encode()), chars))
            at, chars = at + len(x.encode()) + 1, chars + len(x) + 1
    assert [tuple(r) for r in rows] == want
    began = time.perf_counter()
    long = model.split_lines(spark.createDataFrame([(1, "ab\n" * 100_000)], "file_id long, text string"))
    assert long.agg(F.count("line"), F.max("end_byte")).first()[:] == (100_001, 300_000) and time.perf_counter() - began < 30


def test_text_index(spark, tmp_path):
    schema = "file_id int, chunk_hash string, mtime_ns long, rel_path string, start_byte long, heading_path string, text string"
    words = ["red", "fox", "the", "a", "naïve"]
    rnd = random.Random(5)

    def chunks(ids):
        return spark.createDataFrame([(i, str(h), i, f"{i}.md", 0, "H1 fox", " ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))) for i, h in ids], schema).cache()

    first, second = chunks([(k, 0) for k in range(30)]), chunks([(k, k % 3) for k in range(5, 40)])
    second = second.filter("chunk_hash != '0' or file_id >= 30").unionByName(first.filter("file_id between 5 and 29 and file_id % 3 = 0")).cache()
    TextIndex.build(first).write(str(tmp_path / "index"))
    index = TextIndex.read(spark, str(tmp_path / "index")).updated(second)
    fresh = TextIndex.build(second)
    assert sorted(map(str, index.token_counts().collect())) == sorted(map(str, fresh.token_counts().collect()))
    for query in ("red fox", "fox", "the the", "naive a", "fox the red", "none", "?!"):
        scanned = [(r.file_id, r.hits, round(r.bm25, 9)) for r in search.bm25_topk(second, query, 50).collect()]
        assert [(r.file_id, r.hits, round(r.bm25, 9)) for r in index.topk(query, 50).collect()] == scanned
        assert sorted((r.file_id, r.hits, round(r.bm25, 9)) for r in search.bm25(second, query).collect()) == sorted(scanned)
    assert TextIndex.build(first.limit(0)).topk("red", 5).count() == 0


def test_row_numbers_of_a_hot_key(spark):
    df = spark.createDataFrame([(None if k % 7 == 0 else "a", k) for k in range(200)], "key string, k int")
    plain = sorted(map(str, row_numbers(df, ["key"], ["k"]).collect()))
    assert sorted(map(str, row_numbers(df, ["key"], ["k"], bucket=F.expr("k div 9")).collect())) == plain


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(one(index.merge_by_key(old, new, ["k"]))) == [(1, "a"), (2, "d"), (3, "e")]


def test_changes(spark):
    schema = "rel_path string, mtime_ns long, size_bytes long, content_hash string"
    disk = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 2, 2, "y"), ("d", 1, 1, "x")], schema)
    known = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("e", 1, 1, "x")], schema)
    changes = index.classify_changes(disk, known)
    assert dict(one(changes)) == {"a": "unchanged", "b": "touched", "c": "changed", "d": "new", "e": "deleted"}
    assert {r.rel_path: r.mtime_ns for r in index.touch(known, disk, changes).collect()} == {"a": 1, "b": 2, "c": 1, "e": 1}
    assert index.classify_changes(disk.limit(0), known.limit(0)).count() == 0


def test_exports(spark, tmp_path):
    listed = [{"id": "1", "title": "T", "create_time": 1700000000, "messages": [{"role": "user", "content": "b", "create_time": 2}, {"role": "user", "content": "a", "create_time": 1}, {"role": "assistant", "content": "none"}, {"role": "system", "content": "s"}, {"role": "user", "content": " "}]}]
    mapped = {"conversations": [{"conversation_id": "2", "name": "N", "created_at": "2024-01-02T03:04:05Z", "mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi", "you"]}}}, "b": {"message": None}}}]}
    single = {"title": "only", "messages": []}
    for k, data in enumerate((listed, mapped, single)):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("user.json", "[]" * 50)
            z.writestr("conversations.json", json.dumps(data))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = {r.title: r for r in chat_export.read_conversations(spark, str(tmp_path)).collect()}
    assert [m.content for m in got["T"].messages] == ["a", "b", "none"]
    assert got["T"].created_at.year == 2023 and got["N"].messages[0].content == "hi\nyou"
    assert got["only"].conversation_id == hashlib.md5(b"only_").hexdigest()[:16]


def test_transcripts(spark):
    def fetch(first, last, offset):
        return json.dumps([{"id": first, "started_at": f"{first}T10:00:00Z", "structured": {"overview": "o", "action_items": [{"description": "do"}, "else"]}, "transcript_segments": [{"text": "x", "speaker_id": 1}, {"id": "s", "text": "y"}]}])

    rows = transcripts.read_transcripts(spark, "2024-01-01", "2024-01-02", fetch).orderBy("id").collect()
    assert [r.id for r in rows] == ["2024-01-01", "2024-01-02"]
    assert rows[0].action_items == ["do", "else"] and [s.segment_id for s in rows[0].segments] == ["2024-01-01_seg_0", "s"]
    assert [s.speaker_id for s in rows[0].segments] == ["1", "SPEAKER_00"]
    pages = lambda first, last, offset: json.dumps([{"id": f"{first}-{k}"} for k in range(250)][offset : offset + 100])
    assert transcripts.read_transcripts(spark, "2024-01-01", "2024-01-02", pages).select("id").distinct().count() == 500
    with pytest.raises(Exception, match="no further pages"):
        transcripts.read_transcripts(spark, "2024-01-01", "2024-01-01", lambda first, last, offset: pages(first, last, 0)).count()


def test_blocks(spark):
    rows = [("a", "text"), ("b", "x <S>old<E> y"), ("c", "<E> odd <S>"), ("d", None)]
    got = {r.path: (r.status, r.text) for r in conversations.replace_block(spark.createDataFrame(rows, "path string, text string"), "<S>", "<E>", F.lit("n$1\\")).collect()}
    assert got["a"] == ("new", "text\n\n<S>\nn$1\\\n<E>\n") and got["b"] == ("existing", "x <S>\nn$1\\\n<E> y")
    assert got["c"][0] == "recovered" and got["c"][1].count("<S>") == 1 and got["d"][0] == "new"


def test_vault_round_trip(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.createDataFrame([("a/x y.md", "één"), ("state/s.md", "no"), ("b.md", "z")], "path string, text string")
    assert vault.write_texts(df, root) == 3
    got = {r.rel_path: (r.title, r.content.decode(), r.size_bytes) for r in vault.read_vault(spark, root, ["state/*"]).collect()}
    assert got == {"a/x y.md": ("x y", "één", 5), "b.md": ("b", "z", 1)}
    for name in ("empty.md", "_hidden.md", ".dot/ünder +.md"):
        (tmp_path / "v" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "v" / name).write_text("" if name == "empty.md" else "h")
    got = {r.rel_path: (r.content.decode(), r.size_bytes) for r in vault.read_vault(spark, root, ["state/*"]).collect()}
    assert got == {"a/x y.md": ("één", 5), "b.md": ("z", 1), "empty.md": ("", 0), "_hidden.md": ("h", 1), ".dot/ünder +.md": ("h", 1)}
    with pytest.raises(Exception, match="leaves the folder"):
        vault.write_texts(spark.createDataFrame([("../z.md", "")], "path string, text string"), root)
    with pytest.raises(Exception, match="several texts for b.md"):
        vault.write_texts(spark.createDataFrame([("b.md", "1"), ("b.md", "2")], "path string, text string"), root)


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("A", "c1", {"k": "v"}), ("B", None, None)], "event_type string, capture_id string, payload map<string,string>")
    logs.append_events(events, path, "run")
    (tmp_path / "log" / "part-z.json").write_text("{broken\n")
    rows = logs.read_jsonl(spark, path, logs.LEDGER, ["event_id"])
    assert sorted(r.event_type for r in rows.collect()) == ["A", "B"] and {r.run_id for r in rows.collect()} == {"run"}
    assert ledger.tail(logs.numbered_lines(spark, path), 2).count() == 1


def test_review(spark):
    queue = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    actions = spark.createDataFrame([(1, 1, "defer"), (1, 2, "defer"), (1, 3, "approve"), (2, 4, "quit")], "item_id int, seq int, action string")
    got = {r.item_id: (r.status, r.defer_count) for r in ledger.review_fold(queue, actions).collect()}
    assert got == {1: ("approved", 2), 2: ("pending", 0), 3: ("pending", 0)}


def test_streamed_rows_arrive_once(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    row = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, value string").coalesce(1)
    row(1, 2, 2).write.json(source)
    incremental.ingest_new(incremental.stream_jsonl(spark, source, "id int, value string"), table, check, ["id"]).awaitTermination()
    row(2, 3).write.mode("append").json(source)
    incremental.ingest_new(incremental.stream_jsonl(spark, source, "id int, value string"), table, check, ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3]
    row(3, 4).write.mode("append").json(source)
    incremental.ingest_new(incremental.stream_jsonl(spark, source, "id int, value string"), table, str(tmp_path / "anew"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 4]  # another stream neither overwrites nor repeats


def test_glob():
    import re

    assert re.match(vault.glob_regex("state/**"), "state/a/b.md") and not re.match(vault.glob_regex("state/*"), "x/state/a")
    assert re.match(vault.glob_regex("[!a]?.md"), "bc.md")


def test_applied_and_undone_writes(spark):
    items = spark.createDataFrame([("w1", "c1", "Met Ann. \nneed to pay rent\nneed to sleep"), ("w2", "c2", "need to pay rent\nMet Ann and Bo"), ("w3", "c3", None)], "write_id string, capture_id string, text string")
    files = spark.createDataFrame([("daily.md", "# Day\n"), ("todo.md", "# Todo\n- [ ] sleep\n"), ("entities.json", '[{"name": "Zoe", "kind": "TOPIC"}]')], "path string, text string")
    known = spark.createDataFrame([("bo", "TOPIC")], "name string, kind string")
    made = distill.writes(items, files, known, "2024-01-02", "10:00", "daily.md").cache()
    assert {(r.write_id, r.path) for r in made.collect()} == {("w1", "daily.md"), ("w2", "daily.md"), ("w3", "daily.md"), ("w1", "todo.md"), ("w1", "entities.json")}
    after = distill.applied(files, made, {"daily.md": "# Day\n"}).cache()
    texts = {r.path: r.text for r in after.collect()}
    assert texts["todo.md"].count("pay rent") == 1 and texts["todo.md"].count("sleep") == 1 and texts["todo.md"].startswith("# Todo")
    assert [e["name"] for e in json.loads(texts["entities.json"])] == ["Zoe", "Met", "Ann"]
    records = spark.read.schema(distill.RECORD).json(distill.write_records(made, "T").select("value").rdd.map(lambda r: r.value))
    named = distill.find_records(records, ["w1"])
    back, told = distill.undo(after, named)
    assert {r.path: r.status for r in told.collect()} == {"daily.md": "undone", "todo.md": "undone", "entities.json": "skipped"}
    assert {r.path: r.text for r in back.collect()}["todo.md"] == "# Todo\n- [ ] sleep\n"
    everything, _ = distill.undo(after, distill.find_records(records, ["w1", "w2", "w3"]))
    assert {r.path: r.text for r in everything.collect()}["daily.md"] == "# Day\n"
    assert distill.writes(items.limit(0), files, known, "d", "t", "daily.md").count() == 0


def test_entity_array(spark):
    value = "Met Alice, (Bob) bob the The I. A1 using Spark: build Tower. " + " ".join(f"Name{chr(97 + k)}" for k in range(9))
    got = column(spark, [value, "", None], lambda c: F.transform(distill.entity_array(c), lambda e: F.concat_ws(":", e["name"], e["kind"])))
    assert got == [["Met:TOPIC", "Alice:PERSON", "Bob:PERSON", "Spark:TOOL", "Tower:PROJECT", "Namea:PROJECT", "Nameb:TOPIC"], [], []]


def test_review_files(spark):
    schema = "proposal_id string, artifact_type string, title string, content string, destination string"
    rows = [("p1", "task", None, "pay", "x"), ("p2", "task", "T", "sleep", "x"), ("p3", "principle", "P", "be kind", "x"), ("p4", "memory", None, "sun", "x"), ("p5", "decision", None, "go", "x"), ("p6", "entity", "Ann", "who", "x"), ("p7", "entity", "Bo", '{"name": "Bo"}', "x"), ("p8", "note", "N", "text", ""), ("p9", "other", "N", "raw", "o.txt")]
    made = review.dispatch(spark.createDataFrame(rows, schema), "2024-01-02")
    files = spark.createDataFrame([(review.TODO, "# Tasks\n\n- [ ] old\n"), (review.ENTITIES, "{broken")], "path string, text string")
    got = {r.path: r.text for r in review.files_after(files, made).collect()}
    assert got[review.TODO] == "# Tasks\n\n- [ ] old\n- [ ] pay\n- [ ] **T**: sleep\n"
    assert got[review.PRINCIPLES] == "# Personal Principles\n\n## P\n\nbe kind\n" and got["20_memory/daily/2024-01-02.md"] == "# Daily Notes — 2024-01-02\n\nsun\n"
    assert got["50_corrections/decisions/decision_2024-01-02_p5.md"] == "# Decision — 2024-01-02\n\ngo" and got["20_memory/daily/note_p8_2024-01-02.md"] == "# N\n\ntext" and got["o.txt"] == "raw"
    assert [(e["name"], e["proposal_id"]) for e in json.loads(got[review.ENTITIES])] == [("Ann", "p6"), ("Bo", "p7")]
    queue = spark.createDataFrame([("p1", "c", "task", "x", 1, "pending"), ("p2", "c", "task", "x", 2, "deferred"), ("p0", "c", "task", "x", 0, "pending")], "proposal_id string, capture_id string, artifact_type string, destination string, seq int, status string")
    assert [r.proposal_id for r in review.pending(queue, 1).collect()] == ["p0"] and review.pending(queue, 0).count() == 2 and review.pending(queue, status="deferred").count() == 1
    fixed = review.corrected(queue, spark.createDataFrame([("p1", 1, "memory", None, "new", None)], "proposal_id string, seq int, artifact_type string, title string, content string, destination string"))
    record = json.loads(review.override_records(fixed, "d").first().text)
    assert (record["original_type"], record["artifact_type"], record["corrects"], record["destination"]) == ("task", "memory", "p1", "x")


def test_model_answers(spark):
    good = '{"summary": "s", "key_points": ["p"], "tasks": [{"text": "t", "priority": "urgent"}, {"text": "u", "priority": "high"}], "entities": [{"name": "A", "kind": "person"}, {"name": "B", "kind": "planet"}, {"name": "C"}], "confidence": 0.4}'
    rows = {r.k: r for r in classify.coerce_distill(spark.createDataFrame([(1, good), (2, "```\n" + good + "\n```"), (3, "x"), (4, None), (5, "{}")], "k int, answer string")).collect()}
    assert rows[1].tasks == rows[2].tasks and [tuple(t)[:2] for t in rows[1].tasks] == [("t", "med"), ("u", "high")]
    assert [(e.name, e.kind) for e in rows[1].entities] == [("A", "person"), ("C", "topic")] and rows[1].confidence == 0.4
    assert {(rows[k].summary, rows[k].confidence) for k in (3, 4)} == {("Failed to parse LLM response", 0.3)} and rows[5].confidence == 0.7


def test_trace_and_features(spark):
    timed = ask.temporal(hits(spark, [(0.9, "a", 0, 1, "2024-01-01", 5), (0.8, "b", 0, 1, "2024-01-01", 5)]), "hybrid")
    packed = ask.pack(timed, 0)
    row = ask.trace(timed, packed, "q", {"top_k": 3}, "2024-01-02T03:04:05Z").first()
    value = json.loads(row.value)
    assert row.name.startswith("ask_20240102T030405Z_") and [c["rank"] for c in value["candidates"]] == [1, 2] and value["citations"] == ["a:0-1", "b:0-1"]
    assert value["ask_config"] == {"top_k": "3"} and value["candidates"][0]["time_features"]["age_days"] == 0
    again = ask.with_features(ask.rerank(timed, 1).drop("boost", "age_days", "note_type", "temporal_score"), timed)
    assert {r.rel_path: r.boost for r in again.collect()} == {r.rel_path: r.boost for r in timed.collect()}


def test_links_are_cleaned(spark):
    block = "\n- [[chats/tool|Tool]]\n  - about it\n- [[chats/day]]\n  - calm\n- see [[x]] and [[chats/tool]]\n"
    rows = [("a", f"top [[chats/tool]]\n<S>{block}<E>\nend"), ("b", "<S>\n- [[chats/day]]\n<E>"), ("c", "[[chats/tool]] no block"), ("d", None)]
    got = conversations.without_links(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame([("chats/tool",)], "target string"), "<S>", "<E>").collect()
    assert [(r.path, r.text) for r in got] == [("a", "top [[chats/tool]]\n<S>\n- [[chats/day]]\n  - calm\n<E>\nend")]


def test_embedding_work(spark):
    chunks = spark.createDataFrame([("a", 0, 0, "h1"), ("a", 1, 5, "h2"), ("b", 0, 0, "h3")], "rel_path string, ord int, start_byte int, chunk_hash string").withColumns({"model": F.lit("m"), "dim": F.lit(4)})
    stored = chunks.filter("chunk_hash = 'h1'")
    ids = lambda limit: [r.chunk_hash for r in index.missing_embeddings(chunks, stored, limit).collect()]
    assert ids(None) == ["h2", "h3"] and ids(1) == ["h2"] and ids(0) == ids(-1) == []
    with pytest.raises(ValueError, match="no strategy window"):
        markdown.chunk_files(chunks, "m", strategy="window")
