"""Ordered appends by ranges of bytes: the same bytes as one after another, after broken runs too, and taken back again."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from lodestone.operators import distill, review
from lodestone.plans import jobs
from lodestone.sources import appends


def test_many_blocks_of_one_file(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "todo.md").write_text("# Todo\n")
    text = F.concat(F.lit("block é "), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.lit("\n"))
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "notes/day.md").otherwise("todo.md").alias("path"), F.col("id").alias("k"), text.alias("text")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        made = appends.append_texts(rows, root, ["k"], headers={"notes/day.md": "# Day\n", "todo.md": "unused"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    block = lambda k: f"block é {k}{'x' * (k % 50)}\n"
    todo = "# Todo\n" + "".join("\n" + block(k) for k in range(3000) if k % 10)
    day = "# Day\n" + "\n".join(block(k) for k in range(0, 3000, 10))
    assert (tmp_path / "todo.md").read_text() == todo and (tmp_path / "notes" / "day.md").read_text() == day
    folder = next(os.scandir(tmp_path / ".appends")).path
    assert spark.read.parquet(f"{folder}/blocks").filter("path = 'todo.md'").select("part").distinct().count() > 1 and made.count() == 3000

    # Some are taken back, one of them was edited in the meantime.
    data = bytearray((tmp_path / "todo.md").read_bytes())
    edited = made.filter("k = 15").first()
    data[edited.offset + 1] = ord("B")
    (tmp_path / "todo.md").write_bytes(data)
    taken = appends.take_back(spark, root, made.filter("k in (1, 2, 15, 777, 2999)"))
    assert {r.undone for r in taken.collect()} == {True, False} and taken.filter("not undone").first().offset == edited.offset
    left = "# Todo\n" + "".join("\n" + (block(k) if k != 15 else "B" + block(k)[1:]) for k in range(3000) if k % 10 and k not in (1, 2, 777, 2999))
    assert (tmp_path / "todo.md").read_text() == left and not [n for n in os.listdir(root) if n.endswith(".part") or n.endswith(appends.JOURNAL)]
    after = appends.moved(made, taken).filter("path = 'todo.md' and k != 15")
    assert after.count() == 2695 and appends.take_back(spark, root, after).filter("not undone").count() == 0
    assert (tmp_path / "todo.md").read_text() == "# Todo\n\nB" + block(15)[1:]


def test_a_broken_run_is_cut_back(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "a.md").write_text("old")
    (tmp_path / "e.json").write_text('[{"n": 1}]\n')
    rows = spark.createDataFrame([("a.md", 1, "one"), ("e.json", 1, '{"n": 2}'), ("b.md", 1, None)], "path string, k int, text string")
    appends.append_texts(rows, root, ["k"], arrays=("e.json",), close=False)
    assert os.path.exists(tmp_path / f"a.md{appends.JOURNAL}")
    appends.append_texts(rows, root, ["k"], arrays=("e.json",))
    assert (tmp_path / "a.md").read_text() == "old\none" and json.loads((tmp_path / "e.json").read_text()) == [{"n": 1}, {"n": 2}] and (tmp_path / "b.md").read_text() == ""
    assert not [n for n in os.listdir(root) if n.endswith(appends.JOURNAL)]


def test_json_arrays(spark, tmp_path):
    root = str(tmp_path)
    for name, text in (("empty", "[]"), ("blank", " [ ] \n"), ("none", "no array"), ("some", "[1, 2\n]\n"), ("far", "[1" + " " * 9000 + "]" + "\n" * 9000)):
        (tmp_path / name).write_text(text)
    names = ("empty", "blank", "none", "some", "far", "new")
    rows = spark.createDataFrame([(n, k, str(k)) for n in names for k in (7, 8)], "path string, k int, text string")
    appends.append_texts(rows, root, ["k"], arrays=names)
    got = {n: json.loads((tmp_path / n).read_text()) for n in names}
    assert got == {"empty": [7, 8], "blank": [7, 8], "none": [7, 8], "some": [1, 2, 7, 8], "far": [1, 7, 8], "new": [7, 8]}
    assert appends.append_texts(rows.limit(0), root, ["k"]).count() == 0


def test_distilled_and_reviewed_writes_are_the_same_bytes(spark, tmp_path):
    """The files that jobs append to equal the texts that the operators give."""
    root = str(tmp_path)
    items = spark.createDataFrame([(f"w{k}", f"c{k}", f"Met Alice{k}. Project Tower{k % 2}\nTODO: call the bank {k % 3}\nI must sleep {k}.") for k in range(6)], "write_id string, capture_id string, text string")
    old = {"todo.md": "# Todo\ncall the bank 1\n", "entities.json": '[{"name": "Met", "kind": "TOPIC"}]'}
    for name, text in old.items():
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame(list(old.items()), "path string, text string")
    known = spark.createDataFrame([("Met", "TOPIC")], "name string, kind string")
    made = distill.writes(items, files, known, "2024-01-02", "10:00", "daily.md").cache()
    want = {r.path: r.text for r in distill.applied(files, made, {"daily.md": "# Day\n"}).collect()}
    done = jobs.apply_writes(made, root, {"daily.md": "# Day\n"})
    assert {p: (tmp_path / p).read_text() for p in want} == want and set(want) == {"daily.md", "todo.md", "entities.json"} and done.count() == made.count()
    assert appends.take_back(spark, root, done.filter("path = 'daily.md'")).filter("undone").count() == 6 and (tmp_path / "daily.md").read_text() == ""

    schema = "proposal_id string, artifact_type string, title string, content string, destination string"
    rows = [("p1", "task", None, "pay", "x"), ("p2", "task", "T", "sleep", "x"), ("p3", "principle", "P", "be kind", "x"), ("p4", "memory", None, "sun", "x"), ("p5", "decision", None, "go", "x"), ("p6", "entity", "Ann", "who", "x"), ("p7", "entity", "Bo", '{"name": "Bo"}', "x"), ("p8", "note", "N", "text", ""), ("p9", "other", "N", "raw", "o.txt")]
    made = review.dispatch(spark.createDataFrame(rows, schema), "2024-01-02")
    old = {review.TODO: "# Tasks\n\n- [ ] old\n", review.ENTITIES: "{broken"}
    for name, text in old.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    want = {r.path: r.text for r in review.files_after(spark.createDataFrame(list(old.items()), "path string, text string"), made).collect()}
    jobs.apply_review(made, root)
    assert {p: (tmp_path / p).read_text() for p in want} == want and len(want) == 7
