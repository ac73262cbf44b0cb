"""A vault as a stream: each micro-batch is what a listing shows against the one before, deletions included, and brings the index up to date."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans import jobs

SCHEMA = "path string, status string, mtime_ns long, size long"


class VaultChanges(DataSource):
    """Changes of the files under option root; listings are kept under option snapshots, the last ones only.

    An offset is the number of a listing, so a batch that is read again, after a restart too, has the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["root"], self.options["snapshots"], self.options.get("suffix", ".md"))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, snapshots: str, suffix: str):
        self.root, self.snapshots, self.suffix = root, snapshots, suffix

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _file(self, number: int) -> str:
        return os.path.join(self.snapshots, f"{number}.json")

    def _known(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        with open(self._file(number), encoding="utf-8") as file:
            return json.load(file)

    def _listing(self) -> dict[str, list[int]]:
        found = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    try:
                        stat = os.stat(path)
                    except FileNotFoundError:
                        continue  # went between listing and asking
                    found[os.path.relpath(path, self.root)] = [stat.st_mtime_ns, stat.st_size]
        return found

    def _changes(self, old: dict, new: dict) -> Iterator[tuple]:
        rows = []
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                status = "deleted" if path not in new else "new" if path not in old else "changed"
                rows.append((path, status, *new.get(path, [None, None])))
        return iter(rows)  # Spark copies it, which it can't do with a generator

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["listing"]
        old, new = self._known(number), self._listing()
        if old == new:
            return iter(()), start
        os.makedirs(self.snapshots, exist_ok=True)
        part = f"{self._file(number + 1)}.part"
        with open(part, "w", encoding="utf-8") as file:
            json.dump(new, file)
        os.replace(part, self._file(number + 1))
        return self._changes(old, new), {"listing": number + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._changes(self._known(start["listing"]), self._known(end["listing"]))

    def commit(self, end: dict) -> None:
        for number in range(end["listing"] - 1, 0, -1):
            if not os.path.exists(self._file(number)):
                break
            os.remove(self._file(number))


def watch_vault(spark: SparkSession, root: str, store: str, checkpoint: str, once: bool = False, every: str = "10 seconds", **settings) -> StreamingQuery:
    """Keeps the index of index_vault() up to date with the folder: one run of it for each listing that differs from the one before.

    once: stops when the folder as it is has been indexed. A query that starts again on the same checkpoint takes up where
    it stopped; a batch that is done twice changes nothing, as a run only writes what differs. Names and times are listed by
    the driver; the folder has to be one that it sees.
    """
    spark.dataSource.register(VaultChanges)
    changes = spark.readStream.format("vault_changes").option("root", root).option("snapshots", os.path.join(checkpoint, "listings")).load()

    def bring_up(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            jobs.index_vault(batch.sparkSession, root, store, **settings)

    writer = changes.writeStream.foreachBatch(bring_up).option("checkpointLocation", os.path.join(checkpoint, "query"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
