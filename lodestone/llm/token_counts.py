"""Token counts (operator 12): overlap resynchronisation.

A document of up to `size` characters is encoded as it is. A longer one is cut into chunks that overlap; chunks are rows
of their own, so the tasks that encode them share a huge document, and each learns where its tokens begin. Two
neighbours are spliced at the first place of their overlap that is provably a border of the text's own pre-tokens and
at which a token begins in both encodings: up to there the left chunk's tokens are the text's, from there on the right
one's. Documents with a pair that finds no such place are cut again, into longer chunks with wider overlaps, in the end into
a single one.

Why a place is proven: no pre-token of the pattern (see packing) holds a character that isn't white space followed by one
that is, nor a letter followed by anything else. So a border is there in every text that has the two characters, wherever it
begins, and merges never cross a pre-token's border. Special tokens may hold such places; but the left chunk sees those
of its tail whole, so no token begins inside them there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, text_pass, texts, written
from .packing import TokenIds

#: Characters of a chunk, of an overlap; by how much both grow when pairs don't align; characters that one task encodes.
SIZE, OVERLAP, GROWTH, TASK_CHARS = 1 << 15, 256, 8, 4 << 20

# White space and other marks before which a letter's pre-token ends in any case: ASCII and the usual wide ones.
_BLANK, _OTHER = " \t\n\r\x0b\x0c", "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~0123456789，。、；：！？"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿЀ-ҁぁ-ゖァ-ヺ一-龥"
_STABLE = re.compile(rf"(?<=[{_LETTER}])(?=[{re.escape(_BLANK + _OTHER)}])|(?<=[!-~])(?=[{_BLANK}])")


@lru_cache(maxsize=1)
def _specials(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens of a tokenizer's file: a pattern that finds them and their ids. Raises where the proof wouldn't hold."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = content["added_tokens"]
    plain = not content.get("normalizer") and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    overlaps = any(a["content"].endswith(b["content"][:k]) for a in added for b in added for k in range(1, len(b["content"])))
    cut = content.get("pre_tokenizer") or {}
    if not plain or overlaps or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} isn't a byte-level tokenizer whose borders are stable")
    found = {t["content"]: t["id"] for t in added}
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(found, key=len, reverse=True)) + ")") if found else None, found


@lru_cache(maxsize=1)
def _widths(path: str) -> np.ndarray:
    """The bytes of each token."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, added = content["model"]["vocab"], content["added_tokens"]
    out = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in added)]), np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)  # a printable character for each byte
    for t in added:
        out[t["id"]] = len(t["content"].encode())
    return out


class Encoder:
    """Token ids as the tokenizer's file gives them, special tokens found inside texts."""

    def __init__(self, path: str):
        self.ids, self.path = TokenIds(path), path
        self.pattern, self.special = _specials(path)

    def encode(self, text: str) -> np.ndarray:
        parts = self.pattern.split(text) if self.pattern else [text]
        if len(parts) == 1:
            return np.frombuffer(self.ids.encode(parts)[0], "<u4")
        out = [np.array([self.special[p]], "<u4") if k % 2 else np.frombuffer(self.ids.encode([p])[0], "<u4") for k, p in enumerate(parts)]
        return np.concatenate(out)

    def borders(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
        """(number of tokens, for each span of characters the proven borders at which a token begins: (place, tokens before it))."""
        ends = np.cumsum(_widths(self.path)[self.encode(text)])
        out = []
        for a, b in spans:
            base, found = len(text[:a].encode()), []
            at = a
            for m in _STABLE.finditer(text, max(a, 1), b):
                base, at = base + len(text[at : m.start()].encode()), m.start()
                n = int(np.searchsorted(ends, base, "left")) + 1
                if n <= len(ends) and ends[n - 1] == base:
                    found.append((at, n))
            out.append(found)
        return len(ends), out


def _cut(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """(row, k, last, text): the chunks of the texts (row, text); chunk k covers `size` characters from k * size and the overlap."""
    schema = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for row, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                n = max(1, -(-len(text) // size))
                for k in range(n):
                    yield pa.record_batch([[row], [k], [k == n - 1], [text[k * size : (k + 1) * size + (overlap if k < n - 1 else 0)]]], schema=schema)

    return df.select("row", "text").mapInArrow(run, "row long, k long, last boolean, text string")


def _encode_chunks(chunks: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(row, k, last, n, head, tail): a chunk's tokens, and its borders in the overlaps at its head and tail, as (place, tokens before)."""
    border = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("head", border), ("tail", border)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        unseen = max(map(len, encoder.special), default=1) - 1  # a special token that goes on beyond the chunk
        for part in slices(batches):
            out = []
            for row, k, last, text in zip(*(part.column(i).to_pylist() for i in range(3)), texts(part.column(3)), strict=True):
                # The border's second character has to be seen, and no special token may reach over it.
                n, (head, tail) = encoder.borders(text, [(0, min(overlap, len(text) - 1) if k else 0), (0, 0) if last else (size, max(size, len(text) - unseen - 1))])
                out.append({"row": row, "k": k, "last": last, "n": n, "head": [{"at": k * size + a, "n": m} for a, m in head], "tail": [{"at": k * size + a, "n": m} for a, m in tail]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        give_back()

    return chunks.mapInArrow(run, "row long, k long, last boolean, n long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(row, n_tokens) of chunks: null where a pair of neighbours has no border in common."""
    w = Window.partitionBy("row").orderBy("k")
    pairs = encoded.withColumn("next", F.lead("head").over(w))
    common = F.array_intersect(F.transform("tail", lambda b: b["at"]), F.transform("next", lambda b: b["at"]))
    pairs = pairs.withColumn("at", F.array_min(common))
    before = lambda borders: F.get(F.filter(borders, lambda b: b["at"] == F.col("at")), F.lit(0))["n"]
    # What a pair adds: the left chunk's tokens up to the place, less the right chunk's before it.
    own = F.when(F.col("last"), F.col("n")).otherwise(before("tail") - before("next"))
    counted = pairs.select("row", own.alias("own"))
    return counted.groupBy("row").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row: the UTF-8 bytes and the tokens of its text.

    vocabulary: the path of a byte-level tokenizer file that workers can read. A null text is an empty one, without tokens.
    Rows that repeat an id are counted each; a null id stays null; other columns aren't read. No rows give no rows.
    """
    spark = df.sparkSession

    def make():
        encoder, row = Encoder(vocabulary), count(TaskContext.get().partitionId() << 33)

        def work(batch):
            own = texts(batch.column(1))
            n = [len(encoder.encode(t)) if len(t) <= size else None for t in own]
            return {"row": [next(row) for _ in own], "doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in own], "n_tokens": n, "n_chars": [len(t) for t in own], "text": [t if k is None else None for t, k in zip(own, n, strict=True)]}

        return work

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_rows = written(text_pass(rows, ["doc_id", "text"], make, "row long, doc_id long, n_bytes long, n_tokens long, n_chars long, text string"), "counted")
    columns = ["doc_id", "n_bytes", "n_tokens"]
    out, left = all_rows.filter("n_tokens is not null").select(columns), all_rows.filter("n_tokens is null")
    small_batches(spark)
    while chars := left.agg(F.sum("n_chars").alias("n")).first().n:
        chunks = _cut(left, size, overlap).repartition(1 + chars // TASK_CHARS, "row", "k")
        spliced = written(_spliced(_encode_chunks(chunks, vocabulary, size, overlap)), "spliced")
        found = left.drop("n_tokens").join(spliced, "row")
        out = out.unionByName(found.filter("n_tokens is not null").select(columns))
        left = found.filter("n_tokens is null")
        size, overlap = size * GROWTH, overlap * GROWTH
    return out
