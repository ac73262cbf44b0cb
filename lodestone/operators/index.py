"""Keeping an index: change detection, upserts, replaced children, cascading deletes, incremental embedding and text index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digest(df: DataFrame, by: str, order: str, item: Column, separator: str = "|") -> DataFrame:
    """(by, digest): SHA-256 of the items of each group, in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    return df.groupBy(by).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), separator), 256).alias("digest"))


def classify_changes(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(rel_path, status): new, deleted, unchanged (same mtime and size), touched (same content), changed."""
    a, b = disk.alias("a"), known.alias("b")
    j = a.join(b, F.col("a.rel_path") == F.col("b.rel_path"), "full_outer")
    same = (F.col("a.mtime_ns") == F.col("b.mtime_ns")) & (F.col("a.size_bytes") == F.col("b.size_bytes"))
    status = F.when(F.col("b.rel_path").isNull(), "new").when(F.col("a.rel_path").isNull(), "deleted").when(same, "unchanged").when(F.col("a.content_hash") == F.col("b.content_hash"), "touched").otherwise("changed")
    return j.select(F.coalesce("a.rel_path", "b.rel_path").alias("rel_path"), status.alias("status"))


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def merge_by_key(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of updates in place of those with the same keys; of updates that repeat a key one stays, the largest by its other columns."""
    rest = [c for c in current.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__last")).select(*keys, "__last.*") if rest else updates.select(*keys).distinct()
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*current.columns))


def insert_or_ignore(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current and those of the rows whose keys it doesn't have, each key once."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def replace_children(current: DataFrame, children: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """current without the rows of the given parents, and the new children."""
    return current.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(children.select(*current.columns))


def cascade(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(parent), parent, "left_semi")


def touch(known: DataFrame, disk: DataFrame, changes: DataFrame) -> DataFrame:
    """known with the new mtime and size of touched files; their children stay as they are."""
    seen = disk.join(changes.filter("status = 'touched'"), "rel_path", "left_semi").select("rel_path", F.col("mtime_ns").alias("_m"), F.col("size_bytes").alias("_s"))
    rows = known.join(seen, "rel_path", "left")
    return rows.withColumn("mtime_ns", F.coalesce("_m", "mtime_ns")).withColumn("size_bytes", F.coalesce("_s", "size_bytes")).select(*known.columns)


def missing_embeddings(chunks: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks without a vector of their (chunk_hash, model, dim), by path, place; at most `limit`, none for 0 or less."""
    rows = chunks.join(stored.select("chunk_hash", "model", "dim"), ["chunk_hash", "model", "dim"], "left_anti").orderBy("rel_path", "ord", "start_byte")
    return rows if limit is None else rows.limit(max(0, limit))


def plan_hash(content_hash: Column, headings: Column, settings: dict) -> Column:
    """What a file's chunks and vectors depend on, as a hash: its content, its headings' signature, the settings of chunking and embedding."""
    return F.sha2(F.concat_ws("|", content_hash, headings, F.lit("|".join(f"{k}={v}" for k, v in sorted(settings.items())))), 256)


def stale_plans(planned: DataFrame, state: DataFrame) -> DataFrame:
    """Files (rel_path, plan_hash) whose plan isn't the recorded one: only these are chunked again."""
    old = state.select("rel_path", F.col("plan_hash").alias("__old"))
    return planned.join(old, "rel_path", "left").filter(~F.col("plan_hash").eqNullSafe(F.col("__old"))).drop("__old")


def dangling_embeddings(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    return stored.join(chunks.select("chunk_hash"), "chunk_hash", "left_anti")


def text_index_changes(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """(chunk_id, action): insert, update (another hash), skip, delete."""
    a, b = chunks.alias("a"), indexed.alias("b")
    j = a.join(b, F.col("a.chunk_id") == F.col("b.chunk_id"), "full_outer")
    action = F.when(F.col("b.chunk_id").isNull(), "insert").when(F.col("a.chunk_id").isNull(), "delete").when(F.col("a.chunk_hash") == F.col("b.chunk_hash"), "skip").otherwise("update")
    return j.select(F.coalesce("a.chunk_id", "b.chunk_id").alias("chunk_id"), action.alias("action"))


def complete_files(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """file_id of the files all of whose chunks have a vector."""
    seen = chunks.join(stored.select("chunk_hash", F.lit(1).alias("has")).distinct(), "chunk_hash", "left")
    return seen.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("m")).filter("n = m").select("file_id")
