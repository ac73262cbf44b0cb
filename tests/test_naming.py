"""Names dealt at once against names dealt one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conversations, ledger
from lodestone.operators.naming import deal_names
from lodestone.sources import inbox


def one_by_one(items, taken, separator, first):
    used, out = set(taken), {}
    for t, base, extension in sorted(items):
        number, name = first, base + extension
        while name in used:
            name = f"{base}{separator}{number}{extension}"
            number += 1
        used.add(name)
        out[t] = name
    return out


@pytest.mark.parametrize(("seed", "separator", "first", "bucket"), [(1, "_", 1, None), (2, "_", 1, "t div 100"), (3, "-", 2, None), (4, "-", 2, "t div 100")])
def test_names_equal_one_by_one(spark, seed, separator, first, bucket):
    rnd, s = random.Random(seed), separator
    bases = ["a", "a", f"a{s}1", f"a{s}2", f"a{s}3", f"a{s}1{s}1", f"a{s}2{s}3", f"a{s}01", "b", "20240102_101500"]
    items = [(t, rnd.choice(bases), rnd.choice([".x", ".x", ".md", ""])) for t in rnd.sample(range(1000), 70)]
    taken = sorted({rnd.choice(bases) + rnd.choice(["", f"{s}1", f"{s}2", f"{s}4"]) + rnd.choice([".x", ".md"]) for _ in range(12)})
    df = spark.createDataFrame(items, "t long, b string, e string")
    for names in ([], taken) if seed % 2 else (taken,):
        stands = spark.createDataFrame([(n,) for n in names], "file_name string") if names else None
        got = {r.t: r.file_name for r in deal_names(df, "b", "e", ["t"], stands, separator, first, bucket=F.expr(bucket) if bucket else None).collect()}
        assert got == one_by_one(items, names, separator, first)


def test_names_of_the_verdicts_kind(spark):
    """Titles that look like another's with a number, and stamps with underscores, never get a name twice."""
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, "a")], "k int, name string")
    assert [r.file_name for r in ledger.collision_names(items, "name", ["k"]).orderBy("k").collect()] == ["a.json", "a_1.json", "a_1_1.json", "a_2.json"]
    notes = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "a-2"), (4, "g", "a")], "k int, folder string, title string")
    assert [r.path for r in conversations.note_paths(notes, "folder", "title", ["k"]).orderBy("k").collect()] == ["f/a.md", "f/a-2.md", "f/a-2-2.md", "g/a.md"]
    taken = spark.createDataFrame([("capture_20240102_101500.txt",), ("report_2024.pdf",)], "file_name string")
    texts = spark.createDataFrame([("c1", "x"), ("c2", "y")], "capture_id string, text string")
    made = inbox.ingest_texts(texts, "2024-01-02", "20240102_101500", "t", taken).orderBy("capture_id").collect()
    assert [r.path.rsplit("/", 1)[1] for r in made] == ["capture_20240102_101500_1.txt", "capture_20240102_101500_2.txt"]
    files = spark.createDataFrame([("c1", "/tmp/report_2024.pdf", "x")], "capture_id string, original_path string, text string")
    assert inbox.ingest_files(files, "2024-01-02", "t", taken).first().path.endswith("/report_2024_1.pdf")


def test_one_name_of_many_items_in_parts(spark):
    """Thousands of items of one name among thousands of taken ones, with holes."""
    taken = spark.range(3000).filter("id % 5 != 4").select(F.concat(F.lit("x"), F.when(F.col("id") > 0, F.concat(F.lit("_"), F.col("id").cast("string"))).otherwise(""), F.lit(".t")).alias("file_name"))
    items = spark.range(5000).select("id", F.lit("x").alias("b"), F.lit(".t").alias("e"))
    got = [r.file_name for r in deal_names(items, "b", "e", ["id"], taken, bucket=F.expr("id div 500")).orderBy("id").collect()]
    free = [k for k in range(9000) if k >= 3000 or k % 5 == 4][:5000]
    assert got == [f"x_{k}.t" for k in free]


def test_empty_and_null_names(spark):
    none = spark.createDataFrame([], "t long, b string, e string")
    assert deal_names(none, "b", "e", ["t"]).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", ".x"), (3, None, ".x")], "t long, b string, e string")
    assert [r.file_name for r in deal_names(odd, "b", "e", ["t"]).orderBy("t").collect()] == ["", ".x", ".x_1"]
