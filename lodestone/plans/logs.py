"""Registered queries: ledgers, manifests, reviews, sessions, daily rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import ask, conversations, ledger

_E = model.with_sql("ledger")


def ledger_tail(spark, d):
    """The last 200 lines of the event log as JSON text, every seventh of which is broken."""
    e = model.ledger(spark, d)
    json = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("run_id").cast("string").alias("run_id"), "event_type"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), json)).otherwise(json).alias("value"))
    return ledger.tail(lines, 200).select("line_no", "event_id", "run_id", "event_type")


def manifest_totals(spark, d):
    e = model.ledger(spark, d).withColumn("errored", (F.col("k") % 5 == 0).cast("long")).withColumn("discovered", F.lit(1).cast("long"))
    return ledger.totals(e, "event_type", ["discovered", "errored", "k"])


def manifest_latest(spark, d):
    return ledger.latest(model.ledger(spark, d).select("event_type", "event_id", "run_id", "k"), "event_type", ["event_id"])


def resume_watermark(spark, d):
    return ledger.watermark(model.ledger(spark, d), "run_id", "ts").select("run_id", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


def _actions(spark, d):
    names = F.array(*map(F.lit, ("approve", "veto", "correct", "defer", "quit")))
    return model.ledger(spark, d).select(F.col("run_id").alias("item_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("action"))


_ACTIONS = "a AS (SELECT run_id AS item_id, event_id AS seq, ['approve', 'veto', 'correct', 'defer', 'quit'][event_id % 5 + 1] AS action FROM ledger)"


def review_state_fold(spark, d):
    queue = model.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    return ledger.review_fold(queue, _actions(spark, d)).withColumn("status_changed", F.coalesce("status_changed", F.lit(-1)))


def review_tallies(spark, d):
    return ledger.review_tallies(_actions(spark, d))


def _sessions(spark, d):
    """Each customer's orders as a queue, some of them decided already, and the events of the user of that number as keys."""
    orders = model.table(spark, d, "orders")
    queue = orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 9 == 0, "vetoed").otherwise("pending").alias("status"))
    letters = F.array(*map(F.lit, ("a", "V", "c", "d", "?")))
    keys = model.ledger(spark, d).select("run_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 23 == 22, "q").otherwise(F.element_at(letters, (F.col("event_id") % 5 + 1).cast("int"))).alias("key"))
    return queue, keys


def review_sessions(spark, d):
    """What review sessions of at most seven items decide."""
    return ledger.session_actions(*_sessions(spark, d), "run_id", 7).select("run_id", "item_id", F.col("seq").cast("long").alias("seq"), "action")


def review_session_states(spark, d):
    """The statuses of all items after sessions without a limit."""
    state, _ = ledger.review_session(*_sessions(spark, d), "run_id")
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("defer_count").alias("defers"))


_SESSIONS = """q AS (SELECT o_custkey AS run_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 9 != 0),
    p AS (SELECT run_id, event_id, CASE WHEN event_id % 23 = 22 THEN 'quit' ELSE ['approve', 'veto', 'correct', 'defer', NULL][event_id % 5 + 1] END AS action FROM ledger),
    m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM p WHERE action IS NOT NULL),
    k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.run_id = m.run_id AND e.action = 'quit' AND e.n <= m.n)),
    s AS (SELECT run_id, item_id, n AS seq, action FROM q JOIN k USING (run_id, n))"""


def session_last_n_queries(spark, d):
    return ask.last_n(model.ledger(spark, d), ["run_id"], [F.desc("ts"), F.desc("event_id")], 3).select("run_id", "event_id", "event_type")


def session_gaps(spark, d):
    rows = ledger.sessions(model.ledger(spark, d), "run_id", "ts", 6 * 3600)
    return rows.groupBy("run_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def daily_overview_rollup(spark, d):
    e = model.ledger(spark, d).withColumn("run", F.concat(F.lit("u"), (F.col("run_id") % 4).cast("string")))
    return conversations.daily_rollup(e, F.date_format("ts", "yyyy-MM-dd"), "event_id", ["event_type", "run"])


def artifact_collisions(spark, d):
    items = model.ledger(spark, d).select("event_id", F.concat(F.col("event_type"), F.lit("-"), (F.col("run_id") % 10).cast("string")).alias("name"))
    return ledger.collision_names(items, "name", ["event_id"], bucket=F.expr("event_id div 100000")).select("event_id", "file_name")


def ledger_windows(spark, d):
    """Events and values of each type in each window of six hours."""
    g = model.ledger(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")


QUERIES = {
    "ledger_tail": (ledger_tail, f"{_E} SELECT event_id AS line_no, event_id::VARCHAR AS event_id, run_id::VARCHAR AS run_id, event_type FROM (SELECT * FROM ledger ORDER BY event_id DESC LIMIT 200) WHERE event_id % 7 != 0"),
    "manifest_totals": (manifest_totals, f"{_E} SELECT event_type, count(*) AS discovered, count(*) FILTER (k % 5 = 0) AS errored, sum(k)::BIGINT AS k FROM ledger GROUP BY 1"),
    "manifest_latest": (manifest_latest, f"{_E} SELECT event_type, event_id, run_id, k FROM ledger QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1"),
    "resume_watermark": (resume_watermark, f"{_E} SELECT run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS watermark FROM ledger GROUP BY 1"),
    "review_state_fold": (review_state_fold, f"{_E}, {_ACTIONS}, l AS (SELECT item_id, arg_max(action, seq) AS last, count(*) FILTER (action = 'defer') AS defers, max(seq) AS changed FROM a WHERE action != 'quit' GROUP BY 1) SELECT c_custkey AS item_id, CASE last WHEN 'approve' THEN 'approved' WHEN 'veto' THEN 'vetoed' WHEN 'correct' THEN 'corrected' WHEN 'defer' THEN 'deferred' ELSE 'pending' END AS status, coalesce(defers, 0) AS defer_count, coalesce(changed, -1) AS status_changed FROM customer LEFT JOIN l ON c_custkey = item_id"),
    "review_tallies": (review_tallies, f"{_E}, {_ACTIONS} SELECT count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'veto') AS vetoed, count(*) FILTER (action = 'correct') AS corrected, count(*) FILTER (action = 'defer') AS deferred FROM a"),
    "review_sessions": (review_sessions, f"{_E}, {_SESSIONS} SELECT * FROM s WHERE seq <= 7"),
    "review_session_states": (review_session_states, f"{_E}, {_SESSIONS} SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'vetoed' ELSE coalesce(CASE action WHEN 'approve' THEN 'approved' WHEN 'veto' THEN 'vetoed' WHEN 'correct' THEN 'corrected' WHEN 'defer' THEN 'deferred' END, 'pending') END AS status, count(*) AS n, count(*) FILTER (action = 'defer') AS defers FROM orders LEFT JOIN s ON o_orderkey = item_id GROUP BY 1"),
    "session_last_n_queries": (session_last_n_queries, f"{_E} SELECT run_id, event_id, event_type FROM ledger QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) <= 3"),
    "session_gaps": (session_gaps, f"{_E}, g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000)::INT, 1) AS new FROM ledger WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)), s AS (SELECT *, (sum(new) OVER (PARTITION BY run_id ORDER BY ts, event_id))::BIGINT AS session FROM g) SELECT run_id, session, count(*) AS n, min(event_id) AS first FROM s GROUP BY ALL"),
    "daily_overview_rollup": (daily_overview_rollup, f"{_E}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, 'u' || (run_id % 4) AS run FROM ledger), t AS (SELECT day, event_type AS v, min(event_id) AS o FROM e GROUP BY ALL), u AS (SELECT day, run AS v, min(event_id) AS o FROM e GROUP BY ALL) SELECT day, count(*) AS n, (SELECT string_agg(v, ',' ORDER BY o) FROM t WHERE t.day = e.day) AS event_type, (SELECT string_agg(v, ',' ORDER BY o) FROM u WHERE u.day = e.day) AS run FROM e GROUP BY day"),
    "artifact_collisions": (artifact_collisions, f"{_E}, n AS (SELECT event_id, event_type || '-' || (run_id % 10) AS name FROM ledger), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS k FROM n) SELECT event_id, name || (CASE WHEN k > 0 THEN '_' || k ELSE '' END) || '.json' AS file_name FROM r"),
    "ledger_windows": (ledger_windows, f"{_E} SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM ledger GROUP BY ALL"),
}
