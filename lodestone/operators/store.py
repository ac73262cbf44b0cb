"""A table of vectors by content hash, model and dimension; a table of sessions. Tables are immutable: each call returns the next one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ask import last_n
from .index import dangling_embeddings, merge_by_key
from .search import cosine_topk

VECTORS = "chunk_hash string, model string, dim int, vector array<float>"
SESSIONS = "session_id string, created_at string, updated_at string, last_queries array<struct<ts:string,query:string>>, last_sources array<struct<rel_path:string,start_byte:bigint,end_byte:bigint>>, budget map<string,string>"


@dataclass(frozen=True)
class VectorTable:
    """Vectors under the key (chunk_hash, model, dim), so that models and dimensions don't overwrite each other."""

    rows: DataFrame

    def existing(self, hashes: DataFrame, model: str, dim: int) -> DataFrame:
        """Those of the hashes (chunk_hash) that have a vector of the model and dimension."""
        return hashes.join(self._of(model, dim), "chunk_hash", "left_semi")

    def upsert(self, rows: DataFrame) -> VectorTable:
        return VectorTable(merge_by_key(self.rows, rows, ["chunk_hash", "model", "dim"]))

    def without_dangling(self, chunks: DataFrame, model: str, dim: int) -> VectorTable:
        """Without the vectors of this model and dimension whose chunk is gone."""
        gone = dangling_embeddings(self._of(model, dim), chunks)
        return VectorTable(self.rows.join(gone.select("chunk_hash", "model", "dim"), ["chunk_hash", "model", "dim"], "left_anti"))

    def search(self, query: list[float], model: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(chunk_hash, cosine): the k nearest of all, or of the allowed hashes; an empty list of these allows none."""
        rows = self._of(model, len(query))
        rows = rows if allowed is None else rows.join(allowed.select("chunk_hash"), "chunk_hash", "left_semi")
        return cosine_topk(rows, query, k, "chunk_hash")

    def _of(self, model: str, dim: int) -> DataFrame:
        return self.rows.filter((F.col("model") == model) & (F.col("dim") == dim))


def next_session_id(sessions: DataFrame) -> str:
    """Sessions are numbered in the order in which they begin."""
    return f"s{sessions.count() + 1:06d}"


def _kept(old: Column, new: Column, most: int) -> Column:
    """The last `most` of both lists."""
    both = F.concat(F.coalesce(old, F.slice(new, 1, 0)), new)
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)


def append_to_sessions(sessions: DataFrame, rows: DataFrame, column: str, fields: list[str], order: str, most: int) -> DataFrame:
    """sessions with the rows' fields behind those of `column`, by order, the last `most` kept; updated_at follows order.

    A session's rows are cut to its last `most` before they are listed."""
    rows = last_n(rows, ["session_id"], [F.desc(order), *[F.desc(f) for f in fields if f != order]], most)
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    new = rows.groupBy("session_id").agg(items.alias("__new"), F.max(order).cast("string").alias("__at"))
    out = sessions.join(new, "session_id", "left")
    out = out.withColumn(column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(_kept(F.col(column), F.col("__new"), most)))
    return out.withColumn("updated_at", F.coalesce("__at", "updated_at")).select(sessions.columns)
