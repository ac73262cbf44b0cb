"""Which of many strings stand in some text: automata over shards of the strings, through which the texts are streamed."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_bytes

#: Characters of the strings of one automaton, of a piece of a text, and of all pieces that one task streams through an automaton.
SHARD, PIECE, PART = 1 << 20, 1 << 18, 1 << 25


def _pieces(texts: DataFrame, text: str, piece: int, overlap: int) -> DataFrame:
    """(piece): the texts in pieces of `piece` characters, each with the `overlap` that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            held, size = [], 0
            for value in batch.column(0).to_pylist():
                for at in range(0, max(1, len(value) - overlap), piece):
                    held.append(value[at : at + piece + overlap])
                    size += len(held[-1])
                    if size > 4 * piece:
                        yield pa.record_batch([pa.array(held, pa.string())], names=["piece"])
                        held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(held, pa.string())], names=["piece"])

    return texts.select(text).mapInArrow(run, "piece string")


def _found(strings: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """Those of the strings that stand in a piece."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    every = strings["string"].tolist()
    for k, s in enumerate(every):
        automaton.add_word(s, k)
    seen: set[int] = set()
    if every and len(pieces):
        automaton.make_automaton()
        for piece in pieces["piece"]:
            seen.update(k for _, k in automaton.iter(piece))
    return pd.DataFrame({"string": [every[k] for k in sorted(seen)]}, dtype=object)


def standing(strings: DataFrame, texts: DataFrame, string: str = "string", text: str = "text", shard: int = SHARD, piece: int = PIECE, part: int = PART) -> DataFrame:
    """(string): the distinct strings that stand in some text. Null strings and texts don't count; an empty string stands in any text.

    Strings are dealt by hash into shards of about `shard` characters, texts cut into pieces that overlap by the longest
    string, and pieces dealt into parts of about `part` characters: a task has one shard's automaton and one part. So
    neither a long text, nor a beginning that many strings share, nor many strings meet in one place.
    """
    wanted = strings.select(F.col(string).cast("string").alias("string")).filter("string is not null").distinct()
    whole = texts.select(F.col(text).cast("string").alias("text")).filter("text is not null").distinct()
    size = wanted.agg(F.sum(F.char_length("string")).alias("n"), F.max(F.char_length("string")).alias("most")).first()
    chars = whole.agg(F.sum(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not chars.rows or size.most is None:
        return wanted.limit(0)
    empty = wanted.filter("string = ''")
    if not size.n or not chars.n:
        return empty
    shards, parts = 1 + size.n // shard, 1 + chars.n // part
    left = wanted.filter("string != ''").withColumns({"shard": F.pmod(F.xxhash64("string"), F.lit(shards)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    cut = _pieces(whole, "text", piece, size.most - 1).withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)).cast("int"))
    right = cut.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_found, "string string")
    return found.distinct().unionByName(empty)
