"""Vector and session tables."""

from __future__ import annotations

from lodestone.operators import classify, store


def test_vectors(spark):
    chunk = lambda *h: spark.createDataFrame([(x,) for x in h], "chunk_hash string")
    table = store.VectorTable(spark.createDataFrame([], store.VECTORS))
    table = table.upsert(spark.createDataFrame([("a", "m", 2, [1.0, 0.0]), ("b", "m", 2, [1.0, 0.0]), ("a", "n", 2, [0.0, 1.0])], store.VECTORS))
    table = table.upsert(spark.createDataFrame([("b", "m", 2, [0.0, 1.0])], store.VECTORS))
    assert table.rows.count() == 3
    assert [r.chunk_hash for r in table.existing(chunk("a", "c"), "m", 2).collect()] == ["a"]
    assert [r.chunk_hash for r in table.search([0.0, 2.0], "m", 5).collect()] == ["b", "a"]
    assert table.search([0.0, 2.0], "m", 5, chunk()).count() == 0 and table.search([0.0, 0.0], "m", 5).count() == 0
    assert sorted((r.chunk_hash, r.model) for r in table.without_dangling(chunk("b"), "m", 2).rows.collect()) == [("a", "n"), ("b", "m")]


def test_sessions(spark):
    sessions = spark.createDataFrame([("s000001", "t0", "t0", [], None, {}), ("s000002", "t0", "t0", [("t0", "q0")], None, {})], store.SESSIONS)
    assert store.next_session_id(sessions) == "s000003"
    asked = spark.createDataFrame([("s000001", f"t{k}", f"q{k}") for k in (3, 1, 2)], "session_id string, ts string, query string")
    got = {r.session_id: r for r in store.append_to_sessions(sessions, asked, "last_queries", ["ts", "query"], "ts", 2).collect()}
    assert [q.query for q in got["s000001"].last_queries] == ["q2", "q3"] and got["s000001"].updated_at == "t3"
    assert [q.query for q in got["s000002"].last_queries] == ["q0"] and got["s000002"].updated_at == "t0"
    used = spark.createDataFrame([("s000001", 1, "a", 0, 5), ("s000001", 2, "b", 0, 5)], "session_id string, n int, rel_path string, start_byte long, end_byte long")
    kept = store.append_to_sessions(sessions, used, "last_sources", ["rel_path", "start_byte", "end_byte"], "n", 1).filter("session_id = 's000001'").first()
    assert [s.rel_path for s in kept.last_sources] == ["b"]


def test_model_is_a_plug_in(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "need to do this task, must finish")], "id int, text string")
    other = lambda rows, text: rows.withColumns({"label": F.lit("X"), "confidence": F.lit(0.4)})
    assert classify.route_hybrid(df, force_model=True, model=other).first().label == "X"
    assert classify.route_hybrid(df, model=other).first().engine == "rule"
