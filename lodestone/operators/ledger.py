"""Append-only logs and what is folded from them: tails, totals, watermarks, review queues, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .naming import deal_names


def tail(lines: DataFrame, n: int = 20, order: str = "line_no", json: str = "value", schema: str = "event_id string, run_id string, ts string, event_type string, capture_id string, payload map<string,string>") -> DataFrame:
    """The last n lines of a log, then those of them that parse."""
    last = lines.orderBy(F.desc(order)).limit(n)
    return last.select(order, F.from_json(json, schema).alias("e")).filter("e.event_id is not null").select(order, "e.*").orderBy(order)


def totals(records: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return records.groupBy(by).agg(*[F.sum(c).alias(c) for c in columns])


def latest(records: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last record of each source, in order of appending: an aggregate that combines before the shuffle."""
    rest = [c for c in records.columns if c != by]
    return records.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def watermark(records: DataFrame, by: str, time: str) -> DataFrame:
    return records.groupBy(by).agg(F.max(time).alias("watermark"))


# What each review action makes of an item.
STATUS = {"approve": "approved", "veto": "vetoed", "correct": "corrected", "defer": "deferred"}


def review_fold(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """queue (item_id) after actions (item_id, seq, action): status of the last action, number of deferrals."""
    known = actions.filter(F.col("action").isin(*STATUS))
    last = known.groupBy("item_id").agg(F.max_by("action", "seq").alias("last"), F.count_if(F.col("action") == "defer").alias("defers"), F.max("seq").alias("changed"))
    status = F.coalesce(*[F.when(F.col("last") == a, s) for a, s in STATUS.items()], F.lit("pending"))
    return queue.join(last, "item_id", "left").select("item_id", status.alias("status"), F.coalesce("defers", F.lit(0)).alias("defer_count"), F.col("changed").alias("status_changed"))


# The keys of a review session.
KEYS = {"a": "approve", "v": "veto", "c": "correct", "d": "defer", "q": "quit"}


def session_actions(queue: DataFrame, keys: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """(by, item_id, seq, action): what review sessions do, one for each value of `by`.

    queue: by, item_id, seq, status; keys: by, pos, key, as pressed. A session goes through its pending items by seq, at most
    `limit` of them (none or 0: all); each known key, whatever its case, decides one item, others do nothing. The first quit
    ends it, and so do keys or items that run out. seq of the result numbers a session's actions from 1.
    """
    own = Window.partitionBy(by)
    known = F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv])
    pressed = keys.select(by, "pos", F.try_element_at(known, F.lower("key")).alias("action")).filter("action is not null")
    pressed = pressed.withColumn("n", F.row_number().over(own.orderBy("pos")))
    ended = F.min(F.when(F.col("action") == "quit", F.col("n"))).over(own)
    pressed = pressed.withColumn("__end", ended).filter("__end is null or n < __end").drop("__end")
    items = queue.filter("status = 'pending'").withColumn("n", F.row_number().over(own.orderBy("seq", "item_id")))
    items = items.filter(F.col("n") <= limit) if limit else items
    return items.select(by, "item_id", "n").join(pressed.select(by, "n", "action"), [by, "n"]).select(by, "item_id", F.col("n").alias("seq"), "action")


def review_session(queue: DataFrame, keys: DataFrame, by: str, limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queue's items (item_id, status, defer_count, status_changed) after the sessions, and what each session did: (by, approved, vetoed, corrected, deferred).

    A dry run counts, but leaves every item as it was.
    """
    actions = session_actions(queue, keys, by, limit)
    told = actions.groupBy(by).agg(*[F.count_if(F.col("action") == a).alias(s) for a, s in STATUS.items()])
    state = review_fold(queue, actions.limit(0) if dry_run else actions)
    kept = queue.select("item_id", F.col("status").alias("__was"))
    return state.join(kept, "item_id").withColumn("status", F.when(F.col("status") == "pending", F.col("__was")).otherwise(F.col("status"))).drop("__was"), told


def review_tallies(actions: DataFrame) -> DataFrame:
    return actions.agg(*[F.count_if(F.col("action") == a).alias(s) for a, s in STATUS.items()])


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """events with session: a new one after each gap; numbered within the key."""
    w = Window.partitionBy(key).orderBy(time, "event_id")
    at = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.coalesce((at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def free_names(items: DataFrame, name: str, extension: str, taken: DataFrame, order: list[str]) -> DataFrame:
    """items with file_name: the first of name.ext, name_1.ext, name_2.ext that neither taken (file_name) nor an earlier item has; see deal_names()."""
    return deal_names(items, name, extension, order, taken)


def collision_names(items: DataFrame, name: str, order: list[str], bucket: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """items with file_name: name.json, then name_1.json, name_2.json, each once; see deal_names()."""
    return deal_names(items, name, F.lit(".json"), order, taken, bucket=bucket)
