"""Strings that stand in texts, against Python's own search."""

from __future__ import annotations

import random

from lodestone.operators.substrings import standing


def test_equal_to_plain_search(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("ab é") for _ in range(n))
    strings = ["call the bank about " + word(6) for _ in range(120)] + [word(rnd.randrange(5)) for _ in range(60)] + ["漢字", "", None]
    texts = [word(4000) + "call the bank about " + word(9) for _ in range(12)] + strings[:5] + ["x漢字x", "", None]
    a, b = spark.createDataFrame([(s,) for s in strings], "string string"), spark.createDataFrame([(t,) for t in texts], "text string")
    want = {s for s in strings if s is not None and any(t is not None and s in t for t in texts)}
    assert len(want) > 20
    for sizes in ({}, {"shard": 300, "piece": 50, "part": 9000}, {"piece": 1}):
        own = [t for t in texts if t is None or len(t) < 100] if sizes.get("piece") == 1 else texts
        got = [r.string for r in standing(a, spark.createDataFrame([(t,) for t in own], "text string"), **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == {s for s in strings if s is not None and any(t is not None and s in t for t in own)}


def test_nothing_in_nothing(spark):
    none, some = spark.createDataFrame([], "string string"), spark.createDataFrame([("a",), ("",)], "string string")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert standing(none, texts("a")).count() == standing(some, texts(None)).count() == standing(some, texts().limit(0)).count() == 0
    assert [r.string for r in standing(some, texts("")).collect()] == [""]


def test_a_long_text_with_a_beginning_that_all_share(spark):
    """A text of ten million characters is streamed in pieces; all strings begin alike."""
    head = "x" * 150
    text = ("lorem ipsum " * 85 + head + "7") * 8600
    assert len(text) > 10_000_000
    strings = spark.createDataFrame([(head + str(k),) for k in range(400)], "string string")
    assert [r.string for r in standing(strings, spark.createDataFrame([(text,)], "text string"), part=1 << 21).collect()] == [head + "7"]
