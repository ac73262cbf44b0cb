"""Media columns (operator 7): telephony audio.

A payload is stored losslessly as the 8-bit codes of a WAV stream: mu-law or A-law samples, or IMA ADPCM blocks. Reading
it back expands mu-law and A-law by lookup tables, decodes ADPCM blocks with numpy across all blocks of a slice, and
resamples to linear PCM, which is stored as a WAV column again; features are of what that column holds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, text_pass, utf8

RATE, BLOCK = 8_000, 64
#: Samples of an ADPCM block; samples that a task expands at once.
PER_BLOCK, WINDOW = 1 + 2 * (BLOCK - 4), 1 << 18
#: WAV format tags. Fixed values of the container.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part == 0, low, (low + 0x100) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _differences() -> np.ndarray:
    """What each (step, code) adds to the prediction."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
_DIFFERENCES = _differences()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, samples) int16: each step decodes one code of every block at once.

    A block's header is its first sample and step index (any above the last step counts as the last), a block has
    1 + 2 * (BLOCK - 4) samples, low half byte first.
    """
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[:, 0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k, byte in enumerate(columns):
        for half, code in enumerate((byte & 15, byte >> 4)):
            value = np.clip(value + _DIFFERENCES[index * 16 + code], -32768, 32767)
            index = np.clip(index + MOVES[code], 0, len(STEPS) - 1)
            out[:, 1 + 2 * k + half] = value
    return out


def samples(codec: str, size: int) -> int:
    """Samples of a payload of so many bytes."""
    return size // BLOCK * PER_BLOCK if codec == "adpcm" else size // 2 if codec == "pcm" else size


def decode(codec: str, payload: np.ndarray, a: int, b: int) -> np.ndarray:
    """Samples a to b of a payload (bytes as an array): only the codes or blocks that hold them are read."""
    if codec == "pcm":
        return payload[2 * a : 2 * b].view("<i2")
    if codec != "adpcm":
        return TABLES[codec][payload[a:b]]
    first, last = a // PER_BLOCK, -(-b // PER_BLOCK)
    return decode_adpcm(payload[first * BLOCK : last * BLOCK].reshape(-1, BLOCK)).ravel()[a - first * PER_BLOCK : b - first * PER_BLOCK]


def resampled(read: Callable[[int, int], np.ndarray], n: int, rate: int, to: int, window: int = WINDOW) -> Iterator[np.ndarray]:
    """Linear interpolation in whole numbers (rounded down), the last sample held: n * to // rate samples, `window` at a time.

    read(a, b) gives samples a to b, so neither side is ever held whole.
    """
    total = n * to // rate
    for i in range(0, total, window):
        j = min(total, i + window)
        low, high = i * rate // to, min(n, (j - 1) * rate // to + 2)
        wide = read(low, high).astype(np.int64 if rate > 1 << 15 or to > 1 << 15 else np.int32)
        at = np.arange(i, j, dtype=np.int64) * rate
        left, part = at // to - low, (at % to).astype(wide.dtype)
        right = np.minimum(left + 1, len(wide) - 1)
        if to == 2 * rate:  # the usual case, without products
            yield ((wide[left] + np.where(part > 0, wide[right], wide[left])) >> 1).astype(np.int16)
        else:
            yield ((wide[left].astype(np.int64) * (to - part) + wide[right].astype(np.int64) * part) // to).astype(np.int16)


def _header(codec: str, size: int, rate: int) -> bytes:
    """What stands before the payload in a mono WAV file; other formats than PCM say how many samples there are."""
    n = samples(codec, size)
    if codec == "pcm":
        form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, 2 * rate, 2, 16)
    elif codec == "adpcm":
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // PER_BLOCK, BLOCK, 4, 2, PER_BLOCK)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, n)
    body = b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", size)
    return b"RIFF" + struct.pack("<I", 4 + len(body) + size) + b"WAVE" + body


def wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of the codec's units."""
    return _header(codec, len(payload), rate) + payload


def read_wav(media: bytes | np.ndarray) -> tuple[str, int, np.ndarray]:
    """(codec, rate, payload) of what wav() made; the payload is a view."""
    raw = np.frombuffer(media, np.uint8) if isinstance(media, (bytes, bytearray, memoryview)) else media
    codec, rate, at = None, 0, 12
    while True:
        name, size = raw[at : at + 4].tobytes(), int(raw[at + 4 : at + 8].view("<u4")[0])
        if name == b"fmt ":
            tag, _, rate = struct.unpack("<HHI", raw[at + 8 : at + 16].tobytes())
            codec = next(k for k, v in TAGS.items() if v == tag)
        if name == b"data":
            return codec, rate, raw[at + 8 : at + 8 + size]
        at += 8 + size


def to_pcm(media: np.ndarray, rate: int, decoded: np.ndarray | None = None) -> bytearray:
    """A stored WAV as a linear 16-bit WAV of another rate, written window by window. decoded: its samples, if they are known."""
    codec, own, payload = read_wav(media)
    n = samples(codec, len(payload))
    total = n * rate // own
    head = _header("pcm", 2 * total, rate)
    out = bytearray(len(head) + 2 * total)
    out[: len(head)] = head
    target, at = np.frombuffer(out, np.uint8)[len(head) :].view("<i2"), 0
    read = (lambda a, b: decoded[a:b]) if decoded is not None else (lambda a, b: decode(codec, payload, a, b))
    for part in resampled(read, n, own, rate):
        target[at : at + len(part)] = part
        at += len(part)
    return out


def decode_all(media: list[np.ndarray]) -> list[np.ndarray | None]:
    """Samples of the short ADPCM files, whose blocks are decoded together; None for the others, which are read in windows."""
    read = [read_wav(x) for x in media]
    short = [c == "adpcm" and len(p) <= WINDOW for c, _, p in read]
    blocks = [p for (_, _, p), s in zip(read, short, strict=True) if s]
    joined = decode_adpcm(np.concatenate(blocks).reshape(-1, BLOCK)) if blocks else None
    out, at = [], 0
    for (_, _, payload), own in zip(read, short, strict=True):
        n = len(payload) // BLOCK if own else 0
        out.append(joined[at : at + n].ravel() if own else None)
        at += n
    return out


def _views(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each row, without a copy."""
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column.cast(pa.large_binary())]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media for each row of df: the text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a WAV column.

    Without a codec, the payload's CRC picks one of the three, so equal texts are stored alike. A null text is an empty
    one, whose payload is 64 zeros. Texts of any length are stored whole.
    """

    def make():
        def work(batch):
            raw = utf8(batch.column(1))
            padded = [x + bytes(-len(x) % BLOCK or BLOCK * (not x)) for x in raw]
            return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in raw], "media": [wav(codec or CODECS[zlib.crc32(x) % 3], x) for x in padded]}

        return work

    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, "doc_id long, n_bytes long, media binary")


def pcm(df: DataFrame, rate: int = 16_000) -> DataFrame:
    """df (doc_id, n_bytes, media of store()) with pcm: the stored sound expanded, resampled and stored as a linear 16-bit WAV column.

    A sound is expanded and resampled in windows, so besides the two stored forms a task holds some megabytes; a row's forms
    are bounded by the two gigabytes of a column's value. Repeated rows and null ids each get a row.
    """

    def make():
        def work(batch):
            media = _views(batch.column(2))
            made = [bytes(to_pcm(x, rate, known)) for x, known in zip(media, decode_all(media), strict=True)]
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1), "media": batch.column(2), "pcm": made}

        return work

    return text_pass(df, ["doc_id", "n_bytes", "media"], make, "doc_id long, n_bytes long, media binary, pcm binary", SLICE_BYTES // 8)


def _heard(sound: np.ndarray) -> tuple[int, int, int, int]:
    """Peak, root mean square (rounded down), sign changes and CRC-32 of 16-bit samples, window by window."""
    peak = squares = turns = crc = 0
    last = None
    for at in range(0, len(sound), WINDOW):
        y = sound[at : at + WINDOW]
        wide = y.astype(np.int64)
        peak, squares = max(peak, int(np.abs(wide).max(initial=0))), squares + int(np.dot(wide, wide))
        turns += int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0))) + (last is not None and bool(last) != bool(y[0] < 0))
        last, crc = y[-1] < 0, zlib.crc32(y.tobytes(), crc)
    return peak, isqrt(squares // max(1, len(sound))), turns, crc


def features(df: DataFrame) -> DataFrame:
    """What the bytes that pcm() has stored hold and sound like: one row for each of its rows.

    payload and media columns are read back from media; feature, from pcm: codec and samples of media, then samples of the
    resampled sound, its peak, root mean square (rounded down), sign changes and CRC-32. Repeated rows each get a row.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def make():
        def work(batch):
            out = {n: [] for n in names}
            for stored, linear in zip(_views(batch.column(2)), _views(batch.column(3)), strict=True):
                codec, _, payload = read_wav(stored)
                sound = read_wav(linear)[2].view("<i2")
                told = ";".join(map(str, (codec, samples(codec, len(payload)), len(sound), *_heard(sound))))
                for name, value in zip(names, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), told), strict=True):
                    out[name].append(value)
            return out | {"doc_id": batch.column(0), "n_bytes": batch.column(1)}

        return work

    return text_pass(df, ["doc_id", "n_bytes", "media", "pcm"], make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
