"""Periodic run detection (operator 11): a suffix automaton whose suffix-link tree is a link-cut tree.

The words of a text are appended one by one. Each state's colour is the place at which its strings ended last; appending
word i is an access of the whole prefix's state, which recolours the path to the root. The path falls into segments of one
colour each: a segment of colour j whose longest string has L words says that those L words ended at j before. If i - j <=
L, the words before i repeat with period i - j: a square ends at i. As the nearest earlier end is taken, the period is the
smallest. Its first square begins where its run begins, and the run is extended word by word.

Only stretches that can hold a run reach the automaton: in a run of period q and length of at least max(6, 4 q) each
three words, from the second period on, have stood q words earlier or nearer. So there is a stretch of at least 3 q - 2
consecutive places whose three words have stood before at a distance of at most a third of the stretch; others are left
out by counting, which loses no run (tested against brute force).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, utf8

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4


class Automaton:
    """The suffix automaton of the words appended so far, its link tree cut into paths of one colour, each path a splay tree by string length.

    A state's only transition lies in two arrays; only states that branch have a dictionary. A path's colour stands at the
    root of its splay tree. State 1 is the empty string, 0 stands for none.
    """

    def __init__(self, words: int):
        n = 2 * words + 2
        self.length, self.link, self.code, self.target = (array("i", bytes(4 * n)) for _ in range(4))
        self.up, self.left, self.right, self.colour = (array("i", bytes(4 * n)) for _ in range(4))
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last = 1, 1
        self.code[1] = self.colour[1] = -1

    def _splay(self, x: int) -> None:
        """Makes x the root of its splay tree."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                lower = True
            elif right[p] == x:
                lower = False
            else:
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                colour[x] = colour[p]
            elif (left[g] == p) == lower:  # p goes over g before x goes over p
                h = up[g]
                if lower:
                    c = right[p]
                    left[g], right[p] = c, g
                else:
                    c = left[p]
                    right[g], left[p] = c, g
                if c:
                    up[c] = g
                up[g], up[p] = p, h
                if h:
                    if left[h] == g:
                        left[h] = p
                    elif right[h] == g:
                        right[h] = p
                    else:
                        colour[p] = colour[g]
                else:
                    colour[p] = colour[g]
                g = h
                inner = g and (left[g] == p or right[g] == p)
                if not inner:
                    colour[x] = colour[p]
            if lower:
                c = right[x]
                left[p], right[x] = c, p
            else:
                c = left[x]
                right[p], left[x] = c, p
            if c:
                up[c] = p
            up[p], up[x] = x, g
            if inner:
                if left[g] == p:
                    left[g] = x
                else:
                    right[g] = x

    def _copy(self, q: int, length: int) -> int:
        """A state for the strings of q up to a length, between q and its link; they have ended where q's have."""
        self.states = new = self.states + 1
        self.length[new], self.link[new] = length, self.link[q]
        self.code[new], self.target[new] = self.code[q], self.target[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        self._splay(q)
        above = self.left[q]
        self.left[new] = above
        if above:
            self.up[above] = new
        self.left[q], self.up[new] = new, q
        return new

    def append(self, word: int) -> int:
        """Adds a word and returns the state of the whole text."""
        length, link, code, target, more = self.length, self.link, self.code, self.target, self.more
        self.states = cur = self.states + 1
        length[cur] = length[self.last] + 1
        code[cur] = self.colour[cur] = -1
        p, q = self.last, 0
        while p:
            if code[p] == word:
                q = target[p]
                break
            if code[p] == -1:
                code[p], target[p] = word, cur
            else:
                own = more.get(p)
                if own is None:
                    more[p] = {word: cur}
                elif word in own:
                    q = own[word]
                    break
                else:
                    own[word] = cur
            p = link[p]
        if not q:
            link[cur] = 1
        elif length[q] == length[p] + 1:
            link[cur] = q
        else:
            new = self._copy(q, length[p] + 1)
            while p:
                if code[p] == word:
                    if target[p] != q:
                        break
                    target[p] = new
                else:
                    own = more.get(p)
                    if own is None or own.get(word) != q:
                        break
                    own[word] = new
                p = link[p]
            link[cur] = new
        self.up[cur] = link[cur]
        self.last = cur
        return cur

    def access(self, state: int, at: int) -> list[tuple[int, int]]:
        """Gives the path from a state to the root the colour `at`; returns the segments that it had: (colour, longest length)."""
        up, right, colour, length = self.up, self.right, self.colour, self.length
        x, below, out = state, 0, []
        while x:
            self._splay(x)
            was = colour[x]
            if was >= 0:
                out.append((was, length[x]))
            cut = right[x]
            if cut:
                colour[cut] = was
            right[x] = below
            below = x
            x = up[x]
        colour[below] = at
        return out


def runs_between(words: list[int], lo: int, hi: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs, long enough, of which a square lies between lo and hi. words: the whole text, as numbers from 0."""
    found, ends, n = set(), {}, len(words)
    automaton = Automaton(hi - lo)
    for i in range(lo, hi):
        for j, longest in automaton.access(automaton.append(words[i]), i):
            d = i - j
            if d <= longest and ends.get(d, 0) <= i:
                end, start = i + 1, i + 1 - 2 * d
                while end < n and words[end] == words[end - d]:
                    end += 1
                while start and words[start - 1] == words[start - 1 + d]:
                    start -= 1
                ends[d] = end
                if end - start >= max(LEAST, PERIODS * d):
                    found.add((start, end - start, d))
    return found


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def windows(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (from, to) that hold all long enough runs of several texts set one after another.

    words: numbers of words; first[i]: where the text begins that word i belongs to. Equal hashes of different threes only
    make distances smaller and stretches longer, so at worst more goes to the automaton.
    """
    n = len(words)
    if n < LEAST:
        return []
    place = np.arange(n)
    w = words.astype(np.uint64)
    key = first.astype(np.uint64) * _MIX[0] + w * _MIX[1]
    key[1:] += w[:-1] * _MIX[2]
    key[2:] += w[:-2] * _MIX[3]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap = np.full(n, n + 1)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    gap[place - first < 2] = n + 1
    good = gap <= n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        reach = (end - begin + PERIODS - 2) // (PERIODS - 1)  # the longest period that a run within the stretch can have
        most = np.repeat(np.where(end - begin >= LEAST - 3, reach, 0), end - begin)
        keep = gap[good] <= most
        if keep.all():
            return [(max(int(first[a]), int(a - r - 2)), int(b)) for a, b, r in zip(begin, end, reach, strict=True)]
        good[np.flatnonzero(good)[~keep]] = False


def _runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words, by start and period."""
    number: dict[bytes, int] = {}
    codes = [[number.setdefault(w, len(number)) for w in t] for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    begins = np.cumsum(sizes) - sizes
    found: list[set] = [set() for _ in texts]
    for a, b in windows(np.fromiter((c for t in codes for c in t), np.int64, int(sizes.sum())), np.repeat(begins, sizes)):
        k = int(np.searchsorted(begins, a, "right")) - 1
        found[k] |= runs_between(codes[k], int(a - begins[k]), int(b - begins[k]))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d] if runs else words


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed of each row.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of smallest period q with at least
    max(6, 4 q) words that no neighbour extends; collapsed is the text, its words joined by single spaces, without those
    that a run holds after its first period. prepare may change a text's words beforehand. A null or empty text has no
    words and no runs; rows that repeat an id are each a text; other columns aren't read; no rows give no rows. Memory:
    some hundred bytes for each word of a text's longest periodic stretch.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            ids = part.column(0).to_pylist()
            words = [t.split() for t in utf8(part.column(1))]
            if prepare:
                words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
            runs = _runs_of(words)
            short = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            rows = [[{"start": s, "length": m, "period": q} for s, m, q in own] for own in runs]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, run_type), pa.array(short, pa.string())], schema=schema)
        give_back()

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
