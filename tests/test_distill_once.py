"""What is distilled out of a text is computed once for each text, however many columns are made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.operators import distill, notes


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_compute_their_tasks_once(spark):
    df = spark.createDataFrame([("c", "I need to write it\nyou must read it all")], "id string, text string")
    made = distill.tasks(F.col("text"))
    todo = let(made, lambda t: notes.todo_block(F.col("id"), F.lit("d"), t, F.get(t, F.lit(0))["text"]))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    daily = notes.daily_block(F.col("id"), F.lit("t"), F.col("id"), F.lit("s"), F.array().cast("array<string>"), none, made)
    fresh = notes.todo_block(F.col("id"), F.lit("d"), made, F.lit("write it"))
    for block, lines in ((todo, ["- [ ] [MED] read it all"]), (daily, ["- [ ] [MED] write it", "- [ ] [MED] read it all"]), (fresh, ["- [ ] [MED] read it all"])):
        rows = df.select(block.alias("b"))
        assert planned(rows).count("split(") == 1
        assert [x for x in rows.first().b.split("\n") if x.startswith("- ")] == lines


def test_a_line_is_stripped_once(spark):
    df = spark.range(1).select(F.concat(F.lit("x must go home"), F.col("id").cast("string")).alias("text"))
    for made in (distill.tasks(F.col("text")), distill.summary(F.col("text"))):
        plan = planned(df.select(made.alias("m")))
        assert "regexp_replace" not in plan and plan.count("lower(") <= 1


def test_white_space_is_that_of_the_oracles(spark):
    texts = ["\x0bYou must go home  ", "you must go home\t\f\r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [(r.s, r.t[0].text) for r in df.orderBy("i").select(distill.summary(F.col("text")).alias("s"), distill.tasks(F.col("text")).alias("t")).collect()]
    # DuckDB: regexp_replace(text, '^\s+|\s+$', '', 'g')
    assert got == [("\x0bYou must go home  ", "go home  "), ("you must go home", "go home")]


def test_first_words_are_a_short_cut_only(spark):
    texts = ["", "  ", "met Anna and Bob", "a b c d e f Cleo (Dora) met Eve, using Fox the Gin. Ada Ida The Leo", "x " * 900 + "Anna Bob met Cleo", " Anna anna Bob  bob Cleo"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for most in (1, 3, 7):
        rows = [(r.a, r.b, r.c) for r in df.select(distill.entity_array(F.col("text"), most).alias("a"), distill.entity_array(F.col("text"), most, ()).alias("b"), distill.entity_array(F.col("text"), most, (1, 3, 9)).alias("c")).collect()]
        assert all(a == b == c for a, b, c in rows) and any(a for a, _, _ in rows)


def test_tasks_end_with_the_last_that_counts(spark):
    text = "\n".join(f"you must do part {k}" if k % 2 else "nothing" for k in range(40))
    got = spark.createDataFrame([(text,)], "text string").select(distill.tasks(F.col("text")).alias("t")).first().t
    assert [t.text for t in got] == [f"do part {k}" for k in range(1, 14, 2)]


def test_writes_read_the_texts_once(spark):
    items = spark.createDataFrame([("w", "c1", "You must call Anna\nand Bob"), ("v", "c2", "you must call Anna")], "write_id string, capture_id string, text string")
    todo = spark.createDataFrame([("todo.md", "nothing")], "path string, text string")
    known = spark.createDataFrame([("bob", "TOPIC")], "name string, kind string")
    made = distill.writes(items, todo, known, "2024-01-02", "10:00", "daily.md")
    assert "split(" not in planned(made)
    got = {(r.capture_id, r.path): r.inserted_text for r in made.collect()}
    assert set(got) == {("c1", "daily.md"), ("c2", "daily.md"), ("c1", "todo.md"), ("c1", "entities.json")}
    assert "- [ ] [MED] call Anna" in got["c1", "todo.md"] and "Anna" in got["c1", "entities.json"]


def test_new_tasks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    texts = [("a", "you must call Anna"), ("b", "you must call Bob\nyou must go home"), ("c", "nothing")]
    noted_texts = spark.createDataFrame(texts, "id string, text string").mapInArrow(noted, "id string, text string")
    found = noted_texts.select("id", F.posexplode(distill.tasks(F.col("text"))).alias("pos", "t")).select("id", "pos", "t.text")
    fresh = distill.new_tasks(found, spark.createDataFrame([("- call Anna",), (None,)], "todo string"))
    assert fresh.columns == ["id", "pos", "text"] and sorted(map(tuple, fresh.collect())) == [("b", 0, "call Bob"), ("b", 1, "go home")]
    assert made.value == len(texts)
