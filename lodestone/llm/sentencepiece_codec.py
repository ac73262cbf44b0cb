"""SentencePiece encoding and decoding (operator 3): a shared-prefix Viterbi search over sorted words.

A slice's distinct marked words (a run of the space mark, then other characters) are sorted, which lays their trie out
depth-first; the forward table of a word is kept as far as the next word shares its prefix.

For a unigram model the forward entry of a prefix is the score of its best path and the last piece of that. A byte-pair
model's encoding is not the best-scoring path but the one that its merges reach, so there the entry is the one last piece
that is possible: a path is valid if and only if each two neighbours, merged by themselves, stay these two pieces, and
every prefix has exactly one valid path. Both tables are shared across prefixes in the same way.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pass, texts

MARK = "▁"
#: A word with the marks before it; marks at the end of a text. No piece holds a mark behind another character.
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: The same, for models without a piece that holds a newline: no merge reaches over one.
_LINES = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+(?=\n|$)|\n")
#: Bytes of the words, and their ids, that a worker remembers.
CACHE = 40 << 20
#: Pairs of neighbours, and characters of a batch's texts, that it holds at once.
PAIRS, PART_CHARS = 400_000, 2_000_000


class Codec:
    """Ids of texts and texts of ids, as SentencePiece's own encoder and decoder give them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = ModelProto.FromString(file.read()).trainer_spec
        self.unigram = spec.model_type == spec.UNIGRAM
        if not self.unigram and spec.model_type != spec.BPE:
            raise ValueError("neither a unigram nor a byte-pair model")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        self.rank = {p: k for k, (p, _) in enumerate(sorted(self.pieces.items(), key=lambda x: (-model.get_score(x[1]), x[1])))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spell = [b""] * n
        for p, i in self.pieces.items():
            self.spell[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.spell[i] = bytes([b])
        self.names = list(self.rank)  # by rank
        self.numbers = [self.pieces[p] for p in self.names]
        # Ends of pieces of two characters or more: the rank of the piece that it is, or -1.
        self.tails = {p[k:]: -1 for p in self.pieces for k in range(len(p) - 1)} | {p: r for p, r in self.rank.items() if len(p) > 1}
        self.newline = not any("\n" in p for p in self.pieces)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0  # bytes of words
        # The library adds up scores as 32-bit floats; a character that is no piece costs ten more than the worst of them.
        self.scores = {p: np.float32(model.get_score(i)) for p, i in self.pieces.items()} if self.unigram else {}
        self.unknown = min(self.scores.values(), default=np.float32(0)) - np.float32(10)

    def merged(self, text: str) -> list[str]:
        """The merges' result: of neighbours that form a piece, those of the best score merge, the leftmost first."""
        parts, get = list(text), self.rank.get
        while True:
            best = at = None
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at] += parts.pop(at + 1)

    def _stays(self, piece: int) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = len(self.merged(self.names[piece])) == 1
        return known

    def _neighbours(self, a: int, b: int) -> bool:
        """Do the pieces of ranks a and b, merged by themselves, stay these two? A character that is no piece merges with nothing."""
        if a < 0:
            return self._stays(b)
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left, right = self.names[a], self.names[b]
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def best_sorted(self, words: list[str]):
        """Yields (word, the ids of its best path) for sorted distinct words; of equal paths the one with the longest last piece counts.

        The forward table (score of the best path to each place, length of its last piece) reaches over the shared prefix.
        """
        best, sizes, before = [np.float32(0)], [0], ""
        tails, score, unknown = self.tails.get, self.scores.get, self.unknown
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], sizes[shared + 1 :]
            for i in range(shared, len(word)):
                own = score(word[i])
                top, size = best[i] + (unknown if own is None else own), 1
                for at in range(i - 1, -1, -1):
                    rank = tails(word[at : i + 1])
                    if rank is None:
                        break
                    if rank >= 0 and (found := best[at] + self.scores[word[at : i + 1]]) >= top:
                        top, size = found, i + 1 - at
                best.append(top)
                sizes.append(size)
            before, out, i = word, [], len(word)
            while i:
                out.append(word[i - sizes[i] : i])
                i -= sizes[i]
            yield word, self._ids(out[::-1])

    def segment_sorted(self, words: list[str]):
        """best_sorted() of a unigram model; of a byte-pair one the merges' result in the same form."""
        return self.best_sorted(words) if self.unigram else self.merged_sorted(words)

    def merged_sorted(self, words: list[str]):
        """Yields (word, its ids) for sorted distinct words; the table reaches over the prefix shared with the word before."""
        last: list[int] = []  # last[i]: the rank of the last piece of the encoding of word[:i + 1], -1 for a character that is none
        sizes: list[int] = []  # its length
        before, tails, one, pairs, number = "", self.tails.get, self.rank.get, self.pairs, self.numbers
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], sizes[shared:]
            for i in range(shared, len(word)):
                found, size = one(word[i], -1), 1
                for at in range(i - 1, -1, -1):
                    piece = tails(word[at : i + 1])
                    if piece is None:
                        break
                    if piece >= 0:
                        left = last[at - 1] if at else -1
                        fits = pairs.get(left << 20 | piece) if left >= 0 else None
                        if fits or fits is None and self._neighbours(left, piece):
                            found, size = piece, i + 1 - at
                            break
                last.append(found)
                sizes.append(size)
            before = word
            out, i = array("i"), len(word)
            while i:
                rank = last[i - 1]
                if rank >= 0:
                    out.append(number[rank])
                else:
                    out.extend([self.bytes[b] for b in reversed(word[i - 1].encode())])
                i -= sizes[i - 1]
            out.reverse()
            yield word, out.tobytes()

    def _ids(self, parts: list[str]) -> bytes:
        out = []
        for p in parts:
            if p in self.pieces:
                out.append(self.pieces[p])
            else:
                out += [self.bytes[b] for b in p.encode()]
        return array("i", out).tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        out, part, chars = [], [], 0
        for text in batch:
            part.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                out += self._encode(part)
                part, chars = [], 0
        return out + self._encode(part)

    def _encode(self, batch: list[str]) -> list[bytes]:
        unit = _LINES if self.newline else _UNIT
        cut = [unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        known = self.words
        new = set().union(*cut).difference(known)
        for word, ids in self.segment_sorted(sorted(new)):
            known[word] = ids
            self.held += 4 * len(word) + len(ids) + 150
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in list(islice(known, len(known) // 2 + 1)) if self.held > CACHE else ():  # the older half goes
            self.held -= 4 * len(word) + len(known.pop(word)) + 150
        if self.held > CACHE:
            known.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids: bytes are joined (those that aren't UTF-8 replaced), the first word's mark is dropped."""
        seq = np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else ids
        raw = b"".join(map(self.spell.__getitem__, seq.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit) for each row of df; a null or empty text has none. model: path of a file that workers can read."""

    def make():
        own = codec(model)

        def work(batch):
            return {"doc_id": batch.column(0), "ids": own.encode(texts(batch.column(1)))}

        return work

    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, "doc_id long, ids binary")


def decode(df: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text: what the ids column of encode() spells; null ids spell an empty text, repeated rows each get a row."""

    def make():
        own = codec(model)

        def work(batch):
            return {"doc_id": batch.column(0), "ids": batch.column(1), "text": [own.decode(x or b"") for x in batch.column(1).to_pylist()]}

        return work

    return text_pass(df, ["doc_id", "ids"], make, "doc_id long, ids binary, text string")
