"""Periodic runs, token counts and whitening against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import periodic_runs, queries, token_counts, whitening

DATA = "/root/testdata/sf0.001"
VOCABULARY = queries.vocabulary(queries.VOCABULARY)
ODD = [None, "", " ", "\n\n", "a", "a " * 6, "a " * 5, "é é é é é é", "x" * 3000, "漢" * 500, "word " * 5_000, "<|endoftext|>" * 3, "a <|endo ftext|> <|endoftext|>b", "🙂 漢字 \x00 \\ \x85 　 x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, null ids, columns whose names clash with inner ones."""
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(0, None, "x", 1), (None, "null id " * 7, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, row int")


# periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= max(6, 4 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, i)) for p in range(1, q)):
                out.append((s, i - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]


def some_texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        w = [rnd.choice("abcde"[: rnd.choice([1, 2, 2, 3, 5])]) for _ in range(rnd.randrange(60))]
        if w and rnd.random() < 0.6:
            a, p = rnd.randrange(len(w)), rnd.randrange(1, 12)
            w = w[:a] + [w[min(a + (i - a) % p, len(w) - 1)] for i in range(a, len(w))] + [rnd.choice("ab") for _ in range(rnd.randrange(8))]
        yield [x.encode() for x in w]


def test_runs_equal_brute_force():
    for seed in range(40):
        texts = list(some_texts(seed, 40))
        assert periodic_runs._runs_of(texts) == [brute_runs(w) for w in texts]
        for w in texts:  # the automaton alone, over whole texts
            number = {}
            codes = [number.setdefault(x, len(number)) for x in w]
            runs = brute_runs(w)
            assert periodic_runs.runs_between(codes, 0, len(codes)) == set(runs)
            assert periodic_runs.collapse(w, runs) == brute_collapse(w, runs)


def test_segments_tell_the_last_ends():
    """Every access returns, for each suffix of the text, where it ended last."""
    rnd = random.Random(1)
    for _ in range(60):
        w = [rnd.randrange(rnd.choice([2, 3])) for _ in range(40)]
        automaton = periodic_runs.Automaton(len(w))
        for i in range(len(w)):
            segments = automaton.access(automaton.append(w[i]), i)
            for m in range(1, i + 2):
                suffix = w[i + 1 - m : i + 1]
                last = max((j for j in range(i) if j + 1 >= m and w[j + 1 - m : j + 1] == suffix), default=None)
                assert max((j for j, longest in segments if longest >= m), default=None) == last


def test_long_texts_in_linear_memory():
    n = 60_000
    for w in ([b"a"] * n, [b"%d" % (k % 999) for k in range(n)]):
        assert periodic_runs._runs_of([w]) == [[(0, n, len(set(w)))]]


def digests(doc_id, text):
    """The query's row, by brute force."""
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(brute_collapse(w, runs))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_query_equals_brute_force(spark, odd, tmp_path):
    short = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 1500").select("doc_id", "text")
    for df in (short, odd.filter("length(text) < 2000 or text is null").select("doc_id", "text")):
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = queries.op11_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect()
        want = [digests(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert all(v for r in got if r.n_runs for v in (r.length, r.period))


def test_runs_of_odd_rows(spark, odd):
    got = periodic_runs.find_runs(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: len(r.runs) for r in got if r.doc_id in (0, 1, 5, 6, 7)} == {0: 0, 1: 0, 5: 1, 6: 0, 7: 1}
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0
    assert [r.collapsed for r in got if r.doc_id == 10] == ["word"]


# token counts


@pytest.mark.parametrize(("size", "overlap"), [(1 << 15, 256), (100, 30), (64, 16)])
def test_counts_equal_the_library(spark, odd, size, overlap):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(size)
    parts = ["a", "the ", "word ", " ", "  ", "\n", "\n\n", "é", "漢字", "。", "<|endoftext|>", "<|endo", "ftext|>", "12", "'s", "it's ", "...", "🙂", "\x85", "\t", "x" * 50]
    made = spark.createDataFrame([(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1500)))) for k in range(40)], "doc_id long, text string")
    for df in (odd, made):
        got = token_counts.token_counts(df, VOCABULARY, size=size, overlap=overlap).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in df.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(odd.limit(0), VOCABULARY).count() == 0


def test_chunks_of_texts_without_borders_grow(spark):
    """Texts in which no place is provably a border end up as one chunk."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ["x" * 5000, "漢" * 2000, " " * 3000, "x" * 1000 + " and then words " * 50 + "y" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, VOCABULARY, size=64, overlap=16).collect()}
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="stable"):
        token_counts._specials(queries.vocabulary("word_bpe_49k.json"))
    token_counts._specials.cache_clear()


# whitening


def brute_whitening(rows, most=16):
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values)[:most] if values[k] > 1e-11 * values.max()]
    for i, x in kept:
        far = [n * c - s for c, s in zip(x, sums, strict=True)]
        yield i, n, sum(c * c for c in far), (np.array(far) / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("block", [1024, 64])
def test_whitening_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    base[:, 7] = 0.5  # a dimension without variance
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(900 + i % 50, rows[0][1]) for i in range(200)]  # a vector that many rows share, ids that repeat
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [float("-inf")] * 20), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, part int")
    found = whitening.whiten(df, rows=block)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, by = found.collect(), {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    want = list(brute_whitening(rows))
    assert len(got) == 16 * len(want) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for i, n, deviation, white, share in want:
        for k in range(16):
            for r in by[i, k + 1]:
                sign.setdefault(k, np.sign(r.whitened * white[k]))
                assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened - sign[k] * white[k]) < 1e-8 and abs(r.explained - share[k]) < 1e-10


def test_few_vectors(spark):
    def whiten(*rows):
        return sorted(map(tuple, whitening.whiten(spark.createDataFrame(list(rows), "vec_id long, embedding array<float>")).collect()))

    assert whiten() == whiten((1, [1.0, 2.0])) == whiten((1, None)) == whiten((1, [1.0]), (2, [1.0])) == []
    two = whiten((1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [7.0]))
    assert [(r[0], r[1], r[2], r[3], abs(r[4])) for r in two] == [(1, 1, 2, 16384, 1.0), (2, 1, 2, 16384, 1.0)]
    assert [r[3] for r in whiten((1, [1e30, 2.0]), (2, [3.0, 2.0]))] == [None, None]


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = {r.doc_id: r for r in queries.op12_token_counts(spark, DATA).collect()}
    assert len(counts) == docs.count() and all(r.over_limit == (r.n_tokens > 512) for r in counts.values())
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert queries.op13_whitening(spark, DATA).count() == 16 * vectors.count()
