"""A text index as immutable segments: each change adds one, what it replaces is struck from a list, and a generation names what counts.

Under the index's folder:
  segments/seg=<g>/lengths, postings   the chunks that generation g brought, never changed afterwards
  changes/gen=<g>                      files whose rows in segments before g no longer count, and new times of others
  generations/gen=<g>                  one JSON line, written last: its segments, its lists of changes, chunks and tokens in all

A generation counts once its folder is complete, so a run that breaks off leaves the one before in force, and the next run
writes over what it left. Readers keep the files of their generation until three more have come.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import storage
from .textindex import TextIndex

LENGTHS = "file_id {key}, chunk_hash string, mtime_ns long, rel_path string, start_byte long, length long, seg long"
POSTINGS = "token string, file_id {key}, field int, positions array<int>, seg long"
CHANGES = "rel_path string, dead boolean, mtime_ns long, gen long"


@dataclass
class Generation:
    """number; segments: rows by segment; changes: generations whose lists count; chunks and tokens that count in all."""

    number: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    changes: list[int] = field(default_factory=list)
    chunks: int = 0
    tokens: int = 0
    key: str = "long"


@dataclass(frozen=True)
class SegmentedIndex:
    spark: SparkSession
    path: str
    #: Segments that a generation may have before small ones are merged.
    most: int = 8

    def complete(self) -> list[int]:
        """The numbers of the generations that are complete, in order."""
        found = [int(n.removeprefix("gen=")) for n in storage.names(self.spark, f"{self.path}/generations") if n.startswith("gen=")]
        return sorted(n for n in found if storage.exists(self.spark, f"{self.path}/generations/gen={n}/_SUCCESS"))

    def generation(self, number: int | None = None) -> Generation:
        """The generation of that number, or the last complete one; an empty one if there is none."""
        known = self.complete()
        number = known[-1] if number is None and known else number
        if not number:
            return Generation()
        line = self.spark.read.text(f"{self.path}/generations/gen={number}").first().value
        return Generation(**json.loads(line))

    def _read(self, table: str, schema: str, now: Generation) -> DataFrame:
        paths = [f"{self.path}/segments/seg={s}/{table}" for s in now.segments]
        schema = schema.format(key=now.key)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _changes(self, now: Generation) -> DataFrame:
        """rel_path, before (rows of segments before it don't count), mtime (the time that replaces older ones, as of generation since)."""
        if not now.changes:
            return self.spark.createDataFrame([], "rel_path string, before long, mtime long, since long")
        rows = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/changes/gen={g}" for g in now.changes])
        new = F.when(~F.col("dead"), F.col("gen"))
        return rows.groupBy("rel_path").agg(F.max(F.when(F.col("dead"), F.col("gen"))).alias("before"), F.max_by("mtime_ns", new).alias("mtime"), F.max(new).alias("since"))

    def lengths(self, now: Generation) -> DataFrame:
        """The rows of lengths that count, with their segment and the files' last times."""
        rows = self._read("lengths", LENGTHS, now).join(self._changes(now), "rel_path", "left").filter("before is null or seg >= before")
        time = F.when(F.col("since") > F.col("seg"), F.col("mtime")).otherwise(F.col("mtime_ns"))
        return rows.withColumn("mtime_ns", time).select(*[c.split()[0] for c in LENGTHS.split(", ")])

    def index(self, number: int | None = None) -> TextIndex:
        """The index as of a generation, the last one unless told: to be searched without reading a text."""
        now = self.generation(number)
        return TextIndex(self.lengths(now), self._read("postings", POSTINGS, now), (now.chunks, now.tokens))

    def _write_segment(self, part: TextIndex, number: int) -> int:
        """Writes a segment; returns its rows of lengths."""
        folder = f"{self.path}/segments/seg={number}"
        storage.drop(self.spark, folder)  # what a broken run left
        part.lengths.withColumn("seg", F.lit(number).cast("long")).write.parquet(f"{folder}/lengths")
        rows = self.spark.read.parquet(f"{folder}/lengths").count()
        part.postings.withColumn("seg", F.lit(number).cast("long")).repartitionByRange("token", "file_id").sortWithinPartitions("token", "file_id").write.parquet(f"{folder}/postings")
        return rows

    def _finish(self, now: Generation) -> Generation:
        """Counts what the generation has and makes it the one in force."""
        sums = self.lengths(now).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        now.chunks, now.tokens = sums.n, sums.tokens
        line = self.spark.createDataFrame([(json.dumps(asdict(now)),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.path}/generations/gen={now.number}")
        self.vacuum()
        return now

    def add(self, chunks: DataFrame, gone: DataFrame | None = None, touched: DataFrame | None = None, after: int | None = None, columns: tuple[str, ...] = ("heading_path", "text")) -> Generation:
        """A generation with one more segment: the chunks of new and changed files (see TextIndex.build()).

        What earlier segments have of their files, and of the files of gone (rel_path), no longer counts; files of touched
        (rel_path, mtime_ns) get new times. after: the generation that it follows, the last complete one unless told, 0 for
        none; later ones are dropped.
        """
        if after is not None:
            for n in self.complete():
                if n > after:  # of runs whose caller never came to name them
                    storage.drop(self.spark, f"{self.path}/generations/gen={n}")
        old = self.generation(after) if after != 0 else Generation()
        number = old.number + 1
        part = TextIndex.build(chunks, columns)
        now = Generation(number, dict(old.segments), list(old.changes), key=part.lengths.schema["file_id"].dataType.simpleString().replace("bigint", "long"))
        rows = self._write_segment(part, number)
        if rows:
            now.segments[str(number)] = rows
        if old.segments:
            dead = self.spark.read.parquet(f"{self.path}/segments/seg={number}/lengths").select("rel_path")
            dead = dead.unionByName(gone.select("rel_path")) if gone is not None else dead
            listed = dead.distinct().select("rel_path", F.lit(True).alias("dead"), F.lit(None).cast("long").alias("mtime_ns"))
            if touched is not None:
                listed = listed.unionByName(touched.select("rel_path", F.lit(False).alias("dead"), F.col("mtime_ns").cast("long")))
            listed.withColumn("gen", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/changes/gen={number}")
            now.changes.append(number)
        return self._finish(now)

    def due(self, now: Generation) -> list[str]:
        """The segments to be merged: all if less than half of their rows count; with too many, the smallest, as long as the next isn't larger than those before together."""
        by_size = sorted(now.segments, key=lambda s: (now.segments[s], int(s)))
        if sum(now.segments.values()) > 2 * max(1, now.chunks):
            return by_size
        if len(by_size) <= self.most:
            return []
        rows, picked = 0, []
        for s in by_size:
            if len(picked) > len(by_size) - self.most and now.segments[s] > rows:
                break
            rows, picked = rows + now.segments[s], [*picked, s]
        return picked

    def merge(self, everything: bool = False) -> Generation:
        """A generation in which the segments that are due, or all, are one that holds only rows that count; the last one if there is nothing to do."""
        old = self.generation()
        picked = sorted(old.segments, key=int) if everything else self.due(old)
        if not picked or len(picked) == 1 and sum(old.segments.values()) == old.chunks:
            return old
        number = old.number + 1
        parts = Generation(old.number, {s: old.segments[s] for s in picked}, old.changes, key=old.key)
        live = self.lengths(parts)
        # Chunks are far fewer than postings: hashed, so that postings aren't sorted before they are sorted by token.
        postings = self._read("postings", POSTINGS, parts).join(live.select("seg", "file_id").hint("shuffle_hash"), ["seg", "file_id"], "left_semi")
        rows = self._write_segment(TextIndex(live.drop("seg"), postings.drop("seg")), number)
        rest = {s: n for s, n in old.segments.items() if s not in picked} | ({str(number): rows} if rows else {})
        # A list of changes only speaks of segments before it.
        changes = [g for g in old.changes if any(int(s) < g for s in rest)]
        return self._finish(Generation(number, rest, changes, key=old.key))

    def vacuum(self, keep: int = 3) -> None:
        """Deletes what the last `keep` complete generations don't name."""
        known = self.complete()
        kept = [self.generation(n) for n in known[-keep:]]
        if not kept:
            return
        segments, changes = {s for g in kept for s in g.segments}, {g for k in kept for g in k.changes}
        for folder, names in (("segments/seg=", segments), ("changes/gen=", {str(g) for g in changes}), ("generations/gen=", {str(n) for n in known[-keep:]})):
            where, prefix = folder.split("/")
            for name in storage.names(self.spark, f"{self.path}/{where}"):
                number = name.removeprefix(prefix)
                if name.startswith(prefix) and number not in names and int(number) <= kept[-1].number:
                    storage.drop(self.spark, f"{self.path}/{where}/{name}")
