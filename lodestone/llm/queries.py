"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, media, periodic_runs, pii, sentencepiece_codec, toxicity
from .common import documents
from .exact_dedup import exact_dedup
from .packing import pack_documents
from .sharding import shard
from .simhash import near_groups
from .token_counts import token_counts
from .whitening import whiten

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the personal data found in its whole text: counts by kind, a digest of the patterns' spans, all spans with those of disclosing terms."""
    return pii.pii_digests(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the row that stays of its equal texts, how many there are, whether it stays itself, and the digest of its normalised text."""
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number and SHA-256 of its ids, and the SHA-256 of what they decode to."""
    model = vocabulary(PIECES)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(documents(spark, sf_dir), model), model)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return pack_documents(documents(spark, sf_dir), vocabulary(VOCABULARY))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its score by a model of the labels that aren't held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its shard of eight of nearly equal bytes, and its number there; equal texts stay together."""
    out = shard(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document digests and a feature of its text stored as sound, read back from the stored columns."""
    return media.features(media.pcm(media.store(documents(spark, sf_dir))))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation, and one of control strings alone, what is read back from its formatted text and its loss mask."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(rows.unionByName(more), vocabulary(VOCABULARY)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its words, the places of the phrases, the labels of phrases and of templates that chains cover, and a score."""
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its fingerprint and the smallest id that links of fingerprints reach."""
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of some documents (as their ids say) those from a place on repeated with a period; a null id leaves them."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of runs, the longest one, digests of all runs and of the text without repeats."""
    found = periodic_runs.find_runs(documents(spark, sf_dir), prepare=made_periodic)
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    rows = found.withColumn("best", best).withColumn("length", -F.col("best.less"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    milli = F.expr("1000 * length div best.period").alias("exponent_milli")
    listed = F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length", "best.period", milli, listed, F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its UTF-8 bytes, its tokens, and whether these are more than 512."""
    return token_counts(documents(spark, sf_dir), vocabulary(VOCABULARY)).withColumn("over_limit", F.col("n_tokens") > 512)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's whitened components, up to 16."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op7_media that SQL can express."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op9_licenses that SQL can express; -1 for no place."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_sharding promises, as one row: all rows and bytes, in shards whose sizes are within a hundredth of each other, slots without gaps, no group cut."""
    rows = op6_sharding(spark, sf_dir)
    sums = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    whole = rows.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).agg(F.count_if(F.col("n") > 1).alias("cut"))
    law = sums.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"), (F.max("bytes") - F.min("bytes") <= 0.01 * F.max("bytes")).alias("near_equal"), F.every((F.col("first") == 0) & (F.col("last") == F.col("rows") - 1) & (F.col("slots") == F.col("rows"))).alias("gapless"))
    return law.crossJoin(whole)  # one row and one row


def packing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_best_fit_packing promises, as one row: each document begins once, its pieces follow each other and all but the first are full, sequences are gapless from 0 and hold 1024 tokens at most."""
    placed = op4_best_fit_packing(spark, sf_dir)
    own = placed.groupBy("doc_id").agg(F.count_if((F.col("piece") > 0) & (F.col("length") != 1024)).alias("short"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("length").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("end"))
    whole = own.agg(F.count(F.lit(1)).alias("documents"), F.every((F.col("short") == 0) & (F.col("n") == F.col("pieces")) & (F.col("last") == F.col("n") - 1) & (F.col("tokens") == F.col("end"))).alias("whole"))
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.countDistinct("offset").alias("places"), F.count(F.lit(1)).alias("n"))
    law = bins.agg(F.every(F.col("tokens") <= 1024).alias("within_capacity"), F.every((F.col("tokens") == F.col("end")) & (F.col("first") == 0) & (F.col("places") == F.col("n"))).alias("gapless"))
    return whole.crossJoin(law)  # one row and one row


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op13_whitening that SQL can express."""
    return op13_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii, op2_exact_dedup, op3_sentencepiece, op4_best_fit_packing, op5_toxicity, op6_sharding, op7_media, op8_chat, op9_licenses, op10_simhash, op11_periodic_runs, op12_token_counts, op13_whitening, media_payloads, license_phrases, shard_law, packing_law, whitening_deviations)
    return {f.__name__: f for f in own}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped_length(column: str) -> str:
    """Characters of the escaped column: one more for each backslash and for each control string (no two of which overlap)."""
    more = " + ".join(f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}" for s in (*chat.CONTROL, "\\"))
    return f"(length({column}) + {more})"


def _license_sql() -> str:
    tests = {label: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in licenses.PHRASES.items()}
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: {test})) - 1 AS place, '{label}' AS label FROM words" for label, test in tests.items())
    return rf"""WITH words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), places AS ({places}),
        g AS (SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
        SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, coalesce(first, -1) AS first_word, coalesce(last, -1) AS last_word, coalesce(labels, '') AS base_labels FROM words LEFT JOIN g ON g.doc_id = words.doc_id"""


_MEDIA_SQL = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, raw, octet_length(raw)::BIGINT AS n, (CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END)::BIGINT AS more FROM b)
    SELECT doc_id, n AS n_bytes, n + more AS payload_bytes, sha256(raw || from_hex(repeat('00', more))) AS payload_sha256 FROM p"""
_SHARD_SQL = "SELECT count(*) AS rows, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, 8::BIGINT AS shards, true AS near_equal, true AS gapless, 0::BIGINT AS cut FROM documents"
_PACKING_SQL = "SELECT count(*) AS documents, true AS whole, true AS within_capacity, true AS gapless FROM documents"
_WHITENING_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: (floor(64 * c::DOUBLE) + 1000000)::HUGEINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)))),
    u AS (SELECT DISTINCT x FROM v), n AS (SELECT count(*) AS n FROM u), e AS (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM u), s AS (SELECT list(t ORDER BY pos) AS s FROM (SELECT pos, sum(c) AS t FROM e GROUP BY pos))
    SELECT vec_id, n::BIGINT AS n, list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2])))::BIGINT AS deviation FROM v, n, s"""


def oracle_sql() -> dict[str, str]:
    marks = sum(map(len, (chat.TURN, chat.TEXT, chat.END)))
    return {
        "media_payloads": _MEDIA_SQL,
        "license_phrases": _license_sql(),
        "shard_law": _SHARD_SQL,
        "packing_law": _PACKING_SQL,
        "whitening_deviations": _WHITENING_SQL,
        "op2_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOW} AS low FROM documents),
            g AS (SELECT low, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY low)
            SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(low) AS text_sha256
            FROM d JOIN g USING (low)""",
        "op8_chat": f"""
            WITH r AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            g AS (
                SELECT conv_id, count(*)::BIGINT AS n_turns,
                    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                    sum({marks} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
                FROM r GROUP BY conv_id)
            SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    }
