"""Cosine search by clusters against the scan of all vectors."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import search
from lodestone.operators.vectorindex import VectorIndex


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in rows], "file_id long, vector array<float>")


def test_equal_to_the_scan_and_reads_less(spark, tmp_path):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16)) * 4
    rows = [(i, middles[i % 40] + 0.3 * rng.normal(size=16)) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(6000, np.zeros(16)), (6001, None), (6002, [np.nan] * 16)]  # ties, and vectors without a direction
    vectors = frame(spark, rows)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.build(vectors) == 63
    queries = [middles[3], rows[7][1], rng.normal(size=16), np.zeros(16)]
    found, report = index.search([list(map(float, q)) for q in queries], 10)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.file_id, round(r.cosine, 6)))
    whole = frame(spark, rows[:-1]).cache()
    for k, q in enumerate(queries):
        want = [(r.file_id, round(r.cosine, 6)) for r in search.cosine_topk(whole, list(map(float, q)), 10).collect()]
        assert got.get(k, []) == want, k
    assert report["of_rows"] == 4030 and report["of_clusters"] == 63
    near, report = index.search([list(map(float, middles[3]))], 10)
    assert report["rows"] < 0.2 * report["of_rows"] and report["clusters"] < 0.2 * report["of_clusters"] and near.count() == 10

    allow = spark.range(4000).filter("id % 400 = 5").withColumnRenamed("id", "file_id")
    found, _ = index.search([list(map(float, middles[3]))], 5, allow)
    want = search.cosine_topk(whole.join(allow, "file_id", "left_semi"), list(map(float, middles[3])), 5).collect()
    assert [r.file_id for r in found.orderBy("rank").collect()] == [r.file_id for r in want]

    more = frame(spark, [(9000 + i, middles[3] + 0.01 * rng.normal(size=16)) for i in range(5)])
    index.add(more)
    found, report = index.search([list(map(float, middles[3]))], 8)
    want = search.cosine_topk(whole.unionByName(more), list(map(float, middles[3])), 8).collect()
    assert [r.file_id for r in found.orderBy("rank").collect()] == [r.file_id for r in want] and report["of_rows"] == 4035


def test_nothing_to_find(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.search([[1.0, 0.0]], 3)[0].count() == 0
    assert index.build(frame(spark, [])) == 0 and index.search([[1.0, 0.0]], 3)[0].count() == 0
    index.build(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]))
    assert [r.file_id for r in index.search([[1.0, 0.1]], 5)[0].orderBy("rank").collect()] == [1, 2]
    assert index.search([[1.0, 0.1]], 0)[0].count() == 0
    with pytest.raises(ValueError, match="at most"):
        index.search([[1.0, 0.0]] * 300, 1)
