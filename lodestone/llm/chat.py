"""Chat formatting (operator 8): offset-aligned loss masks.

A conversation is rendered whole, with special tokens around each turn, and encoded once with offsets. The sorted spans
of the turns' texts and the sorted spans of the tokens are intersected by binary search; the tokens of assistant texts
carry the loss. Control strings inside a text are broken up by a backslash, reversibly.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What a text must not contain as it stands. The special tokens come first.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_CONTROL, _BACK, _ESCAPED = re.compile("|".join(map(re.escape, CONTROL))), re.compile(r"\\"), re.compile(r"\\(\\?)")
#: Characters of a conversation that are rendered and encoded at once; a longer one is cut between turns, at special tokens.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """No control string is left; each backslash is doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    found.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (TURN, TEXT, END)])
    return found


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns (role, text) and the span of each escaped text in them."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


_END = itemgetter(1)


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation; no text holds a mark, so they part it."""
    for turn in text.split(END)[:-1]:
        role, _, body = turn.partition(TEXT)
        yield unescape(role.removeprefix(TURN)), unescape(body)


def masked_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span, the range of tokens that lie in it: both lists are sorted, so two binary searches find it."""
    return [(bisect_left(offsets, (a,)), bisect_right(offsets, b, key=_END)) if a < b else (0, 0) for a, b in spans]


class Formatter:
    """Feeds turns, in order, of one conversation after another; keeps only what the next part needs."""

    def __init__(self, vocabulary: str):
        self.tokenizer = _tokenizer(vocabulary)

    def part(self, turns: list[tuple[str, str]]) -> dict:
        text, spans = render(turns)
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        ids, offsets = encoded.ids, encoded.offsets  # each access makes the list anew
        mask = bytearray(len(ids))
        loss = []
        own = [s for s, (role, _) in zip(spans, turns, strict=True) if role == "assistant"]
        for (a, b), (i, j) in zip(own, masked_tokens(offsets, own), strict=True):
            if i < j:
                mask[i:j] = b"\1" * (j - i)
                loss.append(unescape(text[max(a, offsets[i][0]) : min(b, offsets[j - 1][1])]))
        return {"text": text, "spans": spans, "ids": ids, "mask": bytes(mask), "loss": loss}


_TEXTS = "conv_id long, part int, text string, ids array<int>, loss_mask binary"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[tuple[str, str]]]]:
    """(conv_id, is the last, turns) for parts of conversations of about PART_CHARS, from rows sorted by conversation."""
    now, turns, chars, begun = None, [], 0, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if begun and (conv != now or chars > PART_CHARS):
                yield now, conv != now, turns
                turns, chars = [], 0
            now, begun = conv, True
            turns.append((role, text))
            chars += len(text)
    if begun:
        yield now, True, turns


def _sorted(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(df: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, part, text, ids, loss_mask: each conversation rendered and encoded, with a 0/1 byte for each token.

    df has conv_id, turn, role, text. Turns are ordered by turn, then role, then text; null turns come first, repeated rows
    stay, a null text or role is empty, rows of null conv_id are one conversation. Only a conversation of more than
    PART_CHARS has several parts, cut between turns, whose tokens follow each other as if encoded together.
    """

    def run(batches):
        chat, part = Formatter(vocabulary), 0
        for conv, last, turns in _runs(batches):
            x = chat.part(turns)
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([x["text"]]), pa.array([x["ids"]], pa.list_(pa.int32())), pa.array([x["mask"]], pa.binary())], names=["conv_id", "part", "text", "ids", "loss_mask"])
            part = 0 if last else part + 1

    return _sorted(df).mapInArrow(run, _TEXTS)


def chat_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each conversation, read back from its rendered text and its mask; the rules are those of format_chats().

    turns_sha256 is over role, newline, unescaped text, newline of each turn as parsed from the output; loss_sha256 is
    over the unescaped text of all masked tokens. A conversation streams through its task part by part.
    """
    names = [f.split()[0] for f in _DIGESTS.split(", ")]

    def run(batches):
        chat = Formatter(vocabulary)
        n = chars = formatted = tokens = masked = 0
        turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
        rows = []
        for conv, last, turns in _runs(batches):
            x = chat.part(turns)
            for role, text in parsed(x["text"]):
                n += 1
                turns_sha.update(f"{role}\n{text}\n".encode())
            for text in x["loss"]:
                chars += len(text)
                loss_sha.update(text.encode())
            formatted, tokens, masked = formatted + len(x["text"]), tokens + len(x["ids"]), masked + sum(x["mask"])
            if last:
                rows.append((conv, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), formatted, tokens, masked))
                n = chars = formatted = tokens = masked = 0
                turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                if len(rows) >= 1000:
                    yield _rows(rows, names)
                    rows = []
        if rows:
            yield _rows(rows, names)

    return _sorted(df).mapInArrow(run, _DIGESTS)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
