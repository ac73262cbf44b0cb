"""Pairs of terms and entities stay in proportion to the texts, and give the same terms as counting each pair."""

from __future__ import annotations

import random

from lodestone.llm import common, pii

from .test_llm import brute_extra


def _made(spark, name):
    """Rows of the last table of that name."""
    folder = next(f for f in reversed(common.written_so_far()) if (spark._jvm.java.io.File(f"{f}/{name}")).exists())
    return spark.read.parquet(f"{folder}/{name}").count()


def test_copies_of_a_list_make_few_pairs(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    names, words = [f"{word()}@{word()}.example" for _ in range(150)], [word() for _ in range(300)]
    text = " ".join(f"{words[2 * k]} {names[k]} {words[2 * k + 1]}" for k in range(150))
    texts = [text] * 4 + [" ".join(rnd.choice(words[:40]) for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: sorted((s["start"], s["end"]) for s in r.extra) for r in pii.find_pii(df).collect()}
    want = brute_extra(texts)
    assert found == {k: sorted(want[k]) for k in range(len(texts))} and found[0]
    assert _made(spark, "pairs") <= 4 * 300  # in proportion to the texts


def test_lists_that_share_some_people(spark):
    """Entities of different sets of rows, terms of different sets, a row that is dealt out to several tasks."""
    rnd = random.Random(9)
    people, words = [f"p{k}@firm{k % 7}.example" for k in range(25)], [f"term{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = [" ".join(rnd.sample(people, rnd.randrange(1, 12)) + rnd.sample(words, 12)) for _ in range(30)] + [" ".join(people + words)] * 2 + ["nothing of note here"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: sorted((s["start"], s["end"]) for s in r.extra) for r in pii.find_pii(df).collect()}
    want = brute_extra(texts)
    assert found == {k: sorted(want[k]) for k in range(len(texts))}


def test_heavy_rows_are_dealt_out(spark):
    terms = spark.range(200).selectExpr("1L as row", "cast(id as string) as term", "3L as n").union(spark.range(3).selectExpr("2L", "cast(id as string)", "3L"))
    entities = spark.range(40).selectExpr("1L as row", "id as class", "3L as own").union(spark.range(5).selectExpr("2L", "id", "3L"))
    got = pii.row_pairs(terms, entities, 8)
    assert got.select("row", "class", "term").distinct().count() == got.count() == 200 * 40 + 3 * 5
    assert got.filter("row = 1").select("part").distinct().count() == 5 and got.filter("row = 2").select("part").distinct().count() == 1
