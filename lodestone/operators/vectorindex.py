"""Exact cosine search that leaves out clusters: vectors lie in Parquet partitions, each with a centroid and the widest angle to it.

By the triangle inequality of angles no vector of a cluster is nearer to a query than the centroid's angle less the widest
one. A search reads the clusters of the best bounds first, and then only those whose bound still reaches the k-th score.
Under the index's folder: vectors/gen=<g>/cluster=<c> and clusters/gen=<g>; a generation counts once its clusters are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.batches import by_bytes

#: Clusters of an index at most, vectors that their centroids are moved by at most, and rows of a cluster that one file holds.
CLUSTERS, SAMPLE, FILE_ROWS = 1024, 100_000, 200_000
#: Queries that are searched at once; what sums of doubles may be off by.
QUERIES, SLACK = 256, 1e-9


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch as doubles, and which of them have a length that isn't 0; of another size than the first, null or not finite, they have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    d = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), d))
    for k in np.flatnonzero(sizes == d):
        if d:
            out[k] = column[int(k)].values.to_numpy(zero_copy_only=False)
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return out, np.sqrt((out * out).sum(axis=1))


def _nearest(centroids: np.ndarray, key: str):
    """(key, vector) -> cluster and angle to its centroid; vectors of length 0 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            x, norm = _units(batch.column(1))
            keep = np.flatnonzero(norm > 0) if x.shape[1] == centroids.shape[1] else np.empty(0, np.int64)
            cos = (x[keep] / norm[keep, None]) @ centroids.T if len(keep) else np.empty((0, len(centroids)))
            at = cos.argmax(axis=1) if len(keep) else np.empty(0, np.int64)
            angle = np.arccos(np.clip(cos[np.arange(len(keep)), at], -1, 1))
            picked = batch.take(pa.array(keep))
            yield pa.record_batch([picked.column(0), picked.column(1), pa.array(at, pa.int32()), pa.array(angle)], names=[key, "vector", "cluster", "angle"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str = "file_id"

    def _generations(self) -> list[int]:
        found = [int(n.removeprefix("gen=")) for n in storage.names(self.spark, f"{self.path}/clusters") if n.startswith("gen=")]
        return sorted(g for g in found if storage.exists(self.spark, f"{self.path}/clusters/gen={g}/_SUCCESS"))

    def clusters(self) -> list:
        """cluster, centroid, radius (the widest angle), n: one row each, CLUSTERS at most."""
        known = self._generations()
        if not known:
            return []
        rows = self.spark.read.parquet(*[f"{self.path}/clusters/gen={g}" for g in known])
        return rows.groupBy("cluster").agg(F.first("centroid").alias("centroid"), F.max("radius").alias("radius"), F.sum("n").alias("n")).orderBy("cluster").collect()

    def build(self, vectors: DataFrame, vector: str = "vector", clusters: int | None = None, rounds: int = 2) -> int:
        """Writes the index of vectors (key, vector) anew; returns how many clusters it has.

        Centroids start as vectors of the smallest hashes of their keys and are moved `rounds` times to the mean of what is
        nearest, on a sample of at most SAMPLE vectors; they only decide how much is left out, never what is found.
        """
        total = vectors.count()
        want = min(CLUSTERS, max(1, int(total**0.5))) if clusters is None else clusters
        sample = vectors.select(self.key, F.col(vector).alias("vector")).orderBy(F.xxhash64(self.key), self.key).limit(max(want, min(SAMPLE, 64 * want)))
        rows = [r.vector for r in sample.select("vector").collect()]  # a bounded sample
        sizes = [len(r) for r in rows if r]
        d = max(set(sizes), key=sizes.count, default=0)
        x = np.array([r for r in rows if r and len(r) == d and all(v is not None for v in r)], float).reshape(-1, max(1, d))
        x = x[np.isfinite(x).all(axis=1)]
        x = x[(x * x).sum(axis=1) > 0]
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else 1
        centroids = np.unique(x[:want], axis=0)
        for _ in range(rounds if len(centroids) else 0):
            near = (x @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, x)
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
        for table in ("vectors", "clusters"):
            storage.drop(self.spark, f"{self.path}/{table}")
        self._write(vectors, vector, centroids, 1)
        return len(centroids)

    def add(self, vectors: DataFrame, vector: str = "vector") -> None:
        """Adds vectors of new keys to the clusters that are there."""
        known = self.clusters()
        if not known:
            self.build(vectors, vector)
            return
        self._write(vectors, vector, np.array([r.centroid for r in known]), self._generations()[-1] + 1, [r.cluster for r in known])

    def _write(self, vectors: DataFrame, vector: str, centroids: np.ndarray, number: int, names: list[int] | None = None) -> None:
        if not len(centroids):
            return
        kind = vectors.schema[self.key].dataType.simpleString()
        dealt = vectors.select(self.key, F.col(vector).cast("array<double>").alias("vector")).mapInArrow(_nearest(centroids, self.key), f"{self.key} {kind}, vector array<double>, cluster int, angle double")
        if names is not None:
            dealt = dealt.withColumn("cluster", F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1))
        folder = f"{self.path}/vectors/gen={number}"
        # A cluster that many share is dealt out by key too.
        salted = dealt.repartition("cluster", F.pmod(F.xxhash64(self.key), F.lit(8)))
        salted.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cluster").parquet(folder)
        stats = self.spark.read.parquet(folder).groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        by_name = self.spark.createDataFrame([(k if names is None else names[k], [float(v) for v in c]) for k, c in enumerate(centroids)], "cluster int, centroid array<double>")
        by_name.join(stats, "cluster", "left").select("cluster", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clusters/gen={number}")

    def _scores(self, picked: dict[int, list[int]], queries: np.ndarray, k: int, allow: DataFrame | None) -> DataFrame:
        """(query, key, cosine): the k best of each query among the clusters picked for it, task by task."""
        rows = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(*[f"{self.path}/vectors/gen={g}" for g in self._generations()]).filter(F.col("cluster").isin(sorted(picked)))
        rows = rows.join(allow.select(self.key).distinct(), self.key, "left_semi") if allow is not None else rows
        kind, key = rows.schema[self.key].dataType.simpleString(), self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, 1 << 20):
                x, norm = _units(batch.column(1))
                clusters = batch.column(2).to_numpy(zero_copy_only=False)
                keys = batch.column(0).to_pylist()
                out_q, out_k, out_c = [], [], []
                for c in np.unique(clusters).tolist():
                    at = np.flatnonzero(clusters == c)
                    mine = picked[c]
                    cos = (x[at] / norm[at, None]) @ queries[mine].T
                    for j, q in enumerate(mine):
                        score = cos[:, j]
                        order = at if len(at) <= k else at[score >= np.partition(score, len(at) - k)[len(at) - k] - SLACK]
                        value = dict(zip(at.tolist(), score.tolist(), strict=True))
                        best = sorted(order.tolist(), key=lambda i: (-round(value[i], 9), keys[i]))[:k]
                        out_q += [q] * len(best)
                        out_k += [keys[i] for i in best]
                        out_c += [value[i] for i in best]
                yield pa.record_batch([pa.array(out_q, pa.int32()), pa.array(out_k, batch.schema.field(0).type), pa.array(out_c, pa.float64())], names=["query", key, "cosine"])

        return rows.select(key, "vector", "cluster").mapInArrow(run, f"query int, {key} {kind}, cosine double")

    def search(self, queries: list[list[float]], k: int, allow: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """((query, key, cosine, rank) of the k nearest of each query, and what was read: clusters, rows, of how many).

        The same as cosine_topk() of all vectors, for each query by its number: ties by key, a query of length 0 finds none.
        allow: only these keys. At most QUERIES at once, as their results so far meet on the driver (k rows each).
        """
        if len(queries) > QUERIES:
            raise ValueError(f"at most {QUERIES} queries at once")
        known = self.clusters()
        q = np.array(queries, float).reshape(len(queries), -1)
        norms = np.sqrt((q * q).sum(axis=1))
        alive = [i for i in range(len(q)) if norms[i] > 0] if known else []
        report = {"clusters": 0, "of_clusters": len(known), "rows": 0, "of_rows": sum(r.n for r in known)}
        kind = next((f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/vectors/gen={self._generations()[0]}").schema if f.name == self.key), "long") if known else "long"
        schema = f"query int, {self.key} {kind}, cosine double, rank int"
        if not alive or k <= 0:
            return self.spark.createDataFrame([], schema), report
        units = q / np.where(norms > 0, norms, 1)[:, None]
        centroids, radius = np.array([r.centroid for r in known]), np.array([r.radius for r in known])
        angle = np.arccos(np.clip(units @ centroids.T, -1, 1))
        bound = np.cos(np.maximum(0.0, angle - radius[None, :])) + SLACK
        order, sizes = np.argsort(-bound, axis=1), np.array([r.n for r in known])
        done: list[set[int]] = [set() for _ in queries]
        best: dict[int, list[tuple]] = {i: [] for i in range(len(queries))}
        read: set[int] = set()
        step = 1
        while alive:
            picked: dict[int, list[int]] = {}
            for i in alive:
                least = best[i][k - 1][0] if len(best[i]) >= k else -np.inf
                rows = 0
                for c in order[i].tolist():
                    if c in done[i] or not sizes[c]:
                        continue
                    # Until k scores are known, clusters of some k rows at a time; then all that may hold a better one.
                    if bound[i, c] < least or least == -np.inf and rows >= k * step:
                        break
                    picked.setdefault(known[c].cluster, []).append(i)
                    done[i].add(c)
                    read.add(c)
                    rows += sizes[c]
            if not picked:
                break
            found = self._scores(picked, units, k, allow)
            top = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), self.key))).filter(F.col("n") <= k)
            for r in top.collect():  # k rows of each query
                best[r.query].append((r.cosine, r[self.key]))
            for i in alive:
                best[i] = sorted(best[i], key=lambda x: (-round(x[0], 9), x[1]))[:k]
            step *= 4
        report |= {"clusters": len(read), "rows": int(sizes[sorted(read)].sum()) if read else 0}
        rows = [(i, key, float(score), n + 1) for i in range(len(queries)) for n, (score, key) in enumerate(best[i])]
        return self.spark.createDataFrame(rows, schema), report
