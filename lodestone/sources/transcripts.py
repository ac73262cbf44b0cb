"""A transcript service as a Spark data source: one partition for each day of the range, one request for each."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, str, int], str]
#: Items of a page, as the service gives them.
PAGE = 100


class _Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch | None):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[_Day]:
        first, last = date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"])
        return [_Day((first + timedelta(k)).isoformat()) for k in range((last - first).days + 1)]

    def _page(self, day: str, offset: int) -> list:
        if self.fetch:
            body = self.fetch(day, day, offset)
        else:
            asked = {"start_date": day, "end_date": day, "include_transcript": "true", "limit": PAGE} | ({"offset": offset} if offset else {})
            request = Request(f"{self.options['url']}?{urlencode(asked)}", headers={"Authorization": f"Bearer {self.options.get('token', '')}"})
            with urlopen(request, timeout=60) as answer:
                body = answer.read().decode()
        data = json.loads(body)
        return data if isinstance(data, list) else data.get("conversations", [])

    def read(self, partition: _Day) -> Iterator[tuple]:
        offset, before = 0, None
        while True:
            items = self._page(partition.day, offset)
            if offset and items == before:
                raise ValueError(f"{partition.day} has {PAGE} items or more, and the service gives no further pages")
            for item in items:
                yield partition.day, json.dumps(item)
            if len(items) < PAGE:
                return
            offset, before = offset + len(items), items


def transcript_source(fetch: Fetch | None = None, name: str = "transcripts") -> type[DataSource]:
    """A data source class to register; fetch(first, last, offset) gives a page of a day's JSON instead of a request, for tests and other services.

    Options: start, end (days, both included), url, token. A day of more than a page is asked for page by page; a service
    that knows no offset, and so repeats its first page, makes the read fail instead of losing the rest.
    """

    class Transcripts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "day string, value string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), fetch)

    return Transcripts


def read_transcripts(spark: SparkSession, start: str, end: str, fetch: Fetch | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(transcript_source(fetch))
    return normalise_transcripts(spark.read.format("transcripts").options(start=start, end=end, **options).load())


def normalise_transcripts(raw: DataFrame, value: str = "value") -> DataFrame:
    """id, started_at, finished_at, overview, category, location, action_items, segments (segment_id, speaker_id, text, created_at) of JSON records."""

    def pick(*keys: str) -> str:
        return "coalesce(" + ", ".join(f"nullif(try_variant_get(v, '$.{k}', 'string'), '')" for k in keys) + ")"

    rows = raw.select(F.expr(f"try_parse_json({value})").alias("v")).select("v", F.expr("try_variant_get(v, '$.id', 'string')").alias("id")).filter("id is not null")
    items = "coalesce(try_variant_get(v, '$.action_items', 'array<variant>'), try_variant_get(v, '$.structured.action_items', 'array<variant>'), cast(array() as array<variant>))"
    item = "coalesce(try_variant_get(a, '$.description', 'string'), try_variant_get(a, '$.text', 'string'), case when schema_of_variant(a) = 'STRING' then try_cast(a as string) end)"
    parts = "coalesce(try_variant_get(v, '$.transcript_segments', 'array<variant>'), try_variant_get(v, '$.transcript', 'array<variant>'), cast(array() as array<variant>))"
    segment = "named_struct('segment_id', coalesce(try_variant_get(s, '$.id', 'string'), concat(id, '_seg_', i)), 'speaker_id', coalesce(try_variant_get(s, '$.speaker_id', 'string'), try_variant_get(s, '$.speaker', 'string'), 'SPEAKER_00'), 'text', coalesce(try_variant_get(s, '$.text', 'string'), ''), 'created_at', try_to_timestamp(try_variant_get(s, '$.created_at', 'string')))"
    return rows.select(
        "id",
        F.expr(f"try_to_timestamp({pick('started_at', 'created_at')})").alias("started_at"),
        F.expr(f"try_to_timestamp({pick('finished_at', 'created_at')})").alias("finished_at"),
        F.expr(pick("overview", "structured.overview")).alias("overview"),
        F.expr(pick("category", "structured.category")).alias("category"),
        F.expr(pick("location", "structured.location")).alias("location"),
        F.expr(f"filter(transform({items}, a -> {item}), x -> x is not null)").alias("action_items"),
        F.expr(f"transform({parts}, (s, i) -> {segment})").alias("segments"),
    )
