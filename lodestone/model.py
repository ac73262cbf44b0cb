"""The data model over the given tables: files, tags, links, lines as chunks, vectors, captures, messages, log events.

Each function reads the tables of a folder and returns a lazy DataFrame; columns that a query doesn't use are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.batches import by_bytes

EPOCH, MONTH_SECONDS = 1_704_067_200, 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    folder = F.when(F.col("doc_id") % 4 == 0, "vault/journal/").otherwise("notes/")
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.concat(folder, "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("title"),
        ((F.lit(EPOCH) + F.col("doc_id") * 7919 % MONTH_SECONDS) * 1_000_000_000).alias("mtime_ns"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("doc_id") % 3 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")).alias("fm_journal_date"),
        F.concat(F.lit("H1 "), "lang", F.lit(" > H2 "), "source").alias("heading_path"),
        "lang",
        "source",
        "text",
    )


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, name, source): language and source as frontmatter tags, label flags as inline tags."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    front = [d.select(F.col("doc_id").alias("file_id"), F.col(c).alias("name"), F.lit("frontmatter").alias("source")) for c in ("lang", "source")]
    inline = [labels.filter(F.col(c) == 1).select(F.col("doc_id").alias("file_id"), F.lit(c).alias("name"), F.lit("inline").alias("source")) for c in ("quality", "toxic")]
    return front[0].unionByName(front[1]).unionByName(inline[0]).unionByName(inline[1])


def outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, target): one link from each file and another from each even one."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    both = d.withColumn("n", d.agg(F.count(F.lit(1)).alias("n")).scalar())
    first = both.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc"), ((F.col("doc_id") * 31 + 7) % F.col("n")).cast("string")).alias("target"))
    second = both.filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc"), ((F.col("doc_id") * 17 + 3) % F.col("n")).cast("string")).alias("target"))
    return first.unionByName(second)


def split_lines(texts: DataFrame) -> DataFrame:
    """(file_id, line, text, start_byte, end_byte, start_char) of (file_id, text): lines with their offsets; the newline isn't part of a line.

    A running sum over each file's own lines, with whole Arrow arrays: linear in the text, and nothing is shuffled. A null
    text is an empty one, which is one empty line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            parts = pc.split_pattern(pc.fill_null(batch.column(1), ""), "\n")
            counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            line = parts.flatten()
            first = np.repeat(np.cumsum(counts) - counts, counts)
            columns = {"file_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), "line": pa.array(np.arange(len(first)) - first, pa.int32()), "text": line}
            for name, sizes in (("byte", pc.binary_length(line)), ("char", pc.utf8_length(line))):
                size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.cumsum(size + 1) - size - 1
                columns[f"start_{name}"] = start - start[first]
                columns[f"end_{name}"] = columns[f"start_{name}"] + size
            yield pa.record_batch({k: columns[k] for k in ("file_id", "line", "text", "start_byte", "end_byte", "start_char")})

    return texts.select(F.col("file_id").cast("long").alias("file_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file_id long, line int, text string, start_byte long, end_byte long, start_char long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_lines() of all documents."""
    return split_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"), F.col("label").alias("model"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and user turns as captured texts."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("capture_id"), F.coalesce("text", F.lit("")).alias("text"))
    said = messages(spark, sf_dir).filter("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("capture_id"), F.col("content").alias("text"))
    return docs.unionByName(said)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


# The same model as DuckDB SQL, for the oracles: common table expressions.
_FILES = f"""files AS (SELECT doc_id AS file_id,
    (CASE WHEN doc_id % 4 = 0 THEN 'vault/journal/' ELSE 'notes/' END) || source || '/' || doc_id || '.md' AS rel_path,
    'doc' || doc_id AS title, ({EPOCH} + (doc_id * 7919) % {MONTH_SECONDS}) * 1000000000 AS mtime_ns,
    octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS content_hash,
    CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') END AS fm_journal_date,
    coalesce(CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') END,
        strftime(make_timestamp(({EPOCH} + (doc_id * 7919) % {MONTH_SECONDS}) * 1000000), '%Y-%m-%d')) AS effective_date,
    'H1 ' || lang || ' > H2 ' || source AS heading_path, lang, source, coalesce(text, '') AS text FROM documents)"""
_TAGS = """file_tags AS (SELECT doc_id AS file_id, lang AS name FROM documents UNION ALL SELECT doc_id, source FROM documents
    UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"""
_LINKS = """outlinks AS (SELECT doc_id AS file_id, 'doc' || ((doc_id * 31 + 7) % (SELECT count(*) FROM documents)) AS target FROM documents
    UNION ALL SELECT doc_id, 'doc' || ((doc_id * 17 + 3) % (SELECT count(*) FROM documents)) FROM documents WHERE doc_id % 2 = 0)"""
_LINES = r"""raw_lines AS (SELECT doc_id AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
    lines AS (SELECT file_id, line::INT AS line, text,
        coalesce(sum(octet_length(encode(text)) + 1) OVER w, 0)::BIGINT AS start_byte,
        (coalesce(sum(octet_length(encode(text)) + 1) OVER w, 0) + octet_length(encode(text)))::BIGINT AS end_byte,
        coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS start_char
        FROM raw_lines WINDOW w AS (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_CAPTURES = """captures AS (SELECT 'd' || doc_id AS capture_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations WHERE role = 'user')"""
_LEDGER = "ledger AS (SELECT event_id, user_id AS run_id, ts, event_type, value, (props->>'k')::BIGINT AS k FROM events)"


def with_sql(*names: str) -> str:
    parts = {"files": _FILES, "file_tags": _TAGS, "outlinks": _LINKS, "lines": _LINES, "captures": _CAPTURES, "ledger": _LEDGER}
    return "WITH " + ", ".join(parts[n] for n in names)
