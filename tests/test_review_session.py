"""Review sessions: limit, quit, keys that do nothing, dry runs."""

from __future__ import annotations

from lodestone.operators import ledger


def test_sessions(spark):
    queue = spark.createDataFrame([("r", k, k, "pending") for k in range(6)] + [("r", 9, -1, "vetoed"), ("s", 20, 1, "pending"), ("t", 30, 1, "pending")], "run_id string, item_id int, seq int, status string")
    keys = spark.createDataFrame([("r", p, k) for p, k in enumerate("aXVdqa")] + [("s", 0, "q"), ("s", 1, "a"), ("u", 0, "a")], "run_id string, pos int, key string")

    def run(**how):
        state, told = ledger.review_session(queue, keys, "run_id", **how)
        return {r.item_id: (r.status, r.defer_count) for r in state.collect()}, {r.run_id: tuple(r)[1:] for r in told.collect()}

    state, told = run()
    assert state == {0: ("approved", 0), 1: ("vetoed", 0), 2: ("deferred", 1), 3: ("pending", 0), 4: ("pending", 0), 5: ("pending", 0), 9: ("vetoed", 0), 20: ("pending", 0), 30: ("pending", 0)}
    assert told == {"r": (1, 1, 0, 1)}
    assert run(limit=2)[1] == {"r": (1, 1, 0, 0)} and run(limit=0)[1] == told
    dry, told = run(dry_run=True)
    assert set(dry.values()) == {("pending", 0), ("vetoed", 0)} and told == {"r": (1, 1, 0, 1)}
    assert ledger.session_actions(queue, keys.limit(0), "run_id").count() == 0
