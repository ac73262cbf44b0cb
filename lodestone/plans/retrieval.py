"""Registered queries: retrieval, the ask stages, vectors and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import storage
from ..functions.text import excerpt
from ..functions.vectors import hash_embed, hash_embedding, weighted_mean
from ..operators import ask, search
from ..operators.segments import SegmentedIndex
from ..operators.textindex import TextIndex
from . import jobs

PHRASE = "of the"
#: The query vector of the registered queries, by rule; the SQL builds the same.
DIM = 64
VECTOR = hash_embed(PHRASE, DIM)
_VEC = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each file as one chunk."""
    return model.files(spark, d).withColumn("start_byte", F.lit(0).cast("long")).withColumn("end_byte", F.col("size_bytes"))


def _best(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "rel_path", "hits", F.round("bm25", 6).alias("bm25"))


def fts_bm25_phrase_topk(spark, d):
    return _best(search.bm25_topk(_chunks(spark, d), PHRASE, 20))


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chunks as they were and as they are: some gone, some new, some changed."""
    now = _chunks(spark, d).withColumn("chunk_hash", F.sha2("text", 256))
    then = now.filter("file_id % 6 != 1").withColumn("text", F.when(F.col("file_id") % 6 == 2, F.lit("of the old version")).otherwise(F.col("text"))).withColumn("chunk_hash", F.sha2("text", 256))
    return then, now.filter("file_id % 6 != 3")


def fts_index_build(spark, d):
    """How many chunks have each token, and how often it stands, out of the index."""
    return TextIndex.build(_chunks(spark, d).withColumn("chunk_hash", F.sha2("text", 256))).token_counts()


def fts_index_update(spark, d):
    """The same of an index that was brought up to date."""
    then, now = _versions(spark, d)
    return TextIndex.build(then).updated(now).token_counts()


def fts_index_search(spark, d):
    """The phrase search on the postings of that index."""
    then, now = _versions(spark, d)
    return _best(TextIndex.build(then).updated(now).topk(PHRASE, 20))


def fts_segments_search(spark, d):
    """The same search on an index of segments: one of the chunks as they were, one of what has changed since, and both merged."""
    then, now = _versions(spark, d)
    store = SegmentedIndex(spark, storage.work_folder(spark))
    store.add(then)
    old = then.select("rel_path", F.col("chunk_hash").alias("was"))
    changed = now.join(old, "rel_path", "left").filter(~F.col("chunk_hash").eqNullSafe(F.col("was"))).drop("was")
    store.add(changed, then.select("rel_path").join(now.select("rel_path"), "rel_path", "left_anti"))
    store.merge(everything=True)
    return _best(store.index().topk(PHRASE, 20))


def _token_sql(where: str) -> str:
    return f"""{model.with_sql("files")}, {_BM25.split("counted AS")[0].rstrip().rstrip(",")}, w AS (SELECT file_id, unnest(list_concat(h, t)) AS token FROM tk {where})
        SELECT token, count(DISTINCT file_id) AS df, count(*) AS tf FROM w GROUP BY token"""


_BM25 = r"""tk AS (SELECT *, regexp_extract_all(strip_accents(lower(heading_path)), '[\p{L}\p{N}]+') AS h, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM files),
    counted AS (SELECT *, (len(h) + len(t))::BIGINT AS dl, (len(list_filter(range(1, len(h)), lambda i: h[i] = 'of' AND h[i + 1] = 'the')) + len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')))::BIGINT AS hits FROM tk),
    st AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (hits > 0) AS df FROM counted),
    bm AS (SELECT counted.*, -greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * hits * 2.2::DOUBLE / (hits + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS bm25 FROM counted, st WHERE hits > 0)"""


def vector_cosine_topk(spark, d):
    return search.cosine_topk(model.embeddings(spark, d), VECTOR, 20).select("file_id", F.round("cosine", 6).alias("cosine"))


_COS = f"cos AS (SELECT vec_id AS file_id, list_cosine_similarity(embedding::DOUBLE[], {_VEC}) AS cosine FROM embeddings)"


def vector_topk_allowlist(spark, d):
    allow = search.with_tags(model.file_tags(spark, d), ["#quality"], False)
    return search.cosine_topk(model.embeddings(spark, d).join(allow, "file_id", "left_semi"), VECTOR, 20).select("file_id", F.round("cosine", 6).alias("cosine"))


def _hybrid(spark, d, **how):
    return search.hybrid(_chunks(spark, d), model.embeddings(spark, d), PHRASE, VECTOR, 10, **how)


def hybrid_fusion_topk(spark, d):
    return _hybrid(spark, d).select(F.col("rank").cast("long").alias("rank"), "file_id", "rel_path", F.round("score", 6).alias("score"), F.round("lex_norm", 6).alias("lex_norm"), F.round("vec_norm", 6).alias("vec_norm"))


def hybrid_prefer_recent(spark, d):
    return _hybrid(spark, d, as_of="2024-01-31").select(F.col("rank").cast("long").alias("rank"), "file_id", "effective_date", F.round("score", 6).alias("score"))


def _ranked_sql(boost: str, k: int) -> str:
    """Common table expressions up to ranked: the k best of both legs."""
    return f"""{_BM25}, {_COS},
        lex AS (SELECT file_id, -bm25 AS lex FROM bm ORDER BY round(bm.bm25, 9), mtime_ns DESC, rel_path LIMIT {5 * k}),
        vec AS (SELECT file_id, cosine FROM cos SEMI JOIN files USING (file_id) ORDER BY round(cosine, 9) DESC, file_id LIMIT {5 * k}),
        both_legs AS (SELECT coalesce(l.file_id, v.file_id) AS file_id, lex, cosine FROM lex l FULL JOIN vec v ON l.file_id = v.file_id),
        scaled AS (SELECT file_id,
            coalesce(CASE WHEN lex IS NULL THEN NULL WHEN max(lex) OVER () = min(lex) OVER () THEN 1.0 ELSE (lex - min(lex) OVER ()) / (max(lex) OVER () - min(lex) OVER ()) END, 0)::DOUBLE AS lex_norm,
            coalesce(CASE WHEN cosine IS NULL THEN NULL WHEN max(cosine) OVER () = min(cosine) OVER () THEN 1.0 ELSE (cosine - min(cosine) OVER ()) / (max(cosine) OVER () - min(cosine) OVER ()) END, 0)::DOUBLE AS vec_norm FROM both_legs),
        scored AS (SELECT *, 0.5::DOUBLE * lex_norm + 0.5::DOUBLE * vec_norm + {boost} AS score FROM scaled JOIN files USING (file_id)),
        ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, mtime_ns DESC, rel_path) AS rank FROM scored QUALIFY rank <= {k})"""


def _hybrid_sql(boost: str, columns: str) -> str:
    return f"{model.with_sql('files')}, {_ranked_sql(boost, 10)} SELECT {columns} FROM ranked"


def tag_filter_or(spark, d):
    return search.with_tags(model.file_tags(spark, d), ["de", "#toxic"], False)


def tag_filter_and(spark, d):
    return search.with_tags(model.file_tags(spark, d), ["en", "quality", "#quality"], True)


def effective_date_range(spark, d):
    return search.in_dates(model.files(spark, d), "2024-01-05", "2024-01-12").select("file_id", "rel_path", "effective_date")


def allowed_chunks_under_filters(spark, d):
    return search.allowed(model.files(spark, d), model.file_tags(spark, d), ["en"], True, "2024-01-03", "2024-01-20").select("file_id", "content_hash")


def _seeds(spark, d):
    """The files of the ten best hits."""
    return _hybrid(spark, d).select("file_id", "title")


def link_neighbors_1hop(spark, d):
    near = search.expand_links(_seeds(spark, d), model.files(spark, d), model.outlinks(spark, d), 25)
    return near.select("file_id", "rel_path", "effective_date", "score", "expanded_context")


_NEAR = """near AS (SELECT o.file_id FROM outlinks o JOIN ranked s ON o.target = s.title
        UNION SELECT f.file_id FROM outlinks o JOIN ranked s ON o.file_id = s.file_id JOIN files f ON f.title = o.target)"""


def neighbor_representative_chunk(spark, d):
    near = search.neighbours(_seeds(spark, d), model.files(spark, d), model.outlinks(spark, d))
    lines = model.lines(spark, d).filter("text != ''").join(near, "file_id", "left_semi")
    return search.representative_chunk(lines, F.lit(2)).select("file_id", "line", "start_byte", "end_byte")


def excerpt_window(spark, d):
    return model.files(spark, d).select("file_id", excerpt(F.col("text"), " Of The ", 200, 40, 160).alias("excerpt"))


def _excerpt_sql(query: str, most: int, before: int, after: int, source: str, name: str) -> str:
    """A common table expression: all of source, with excerpt."""
    n = len(query)
    return f"""{name}_a AS (SELECT *, instr(lower(text), '{query}') - 1 AS p0, length(text) AS n FROM {source}),
        {name}_w AS (SELECT *, CASE WHEN p0 < 0 THEN 0 ELSE greatest(0, p0 - {before}) END AS s FROM {name}_a),
        {name}_e AS (SELECT *, CASE WHEN p0 < 0 THEN least(n, s + {most}) ELSE least(greatest(least(n, s + {most}), least(n, p0 + {n} + {after})), s + {most}) END AS e FROM {name}_w),
        {name} AS (SELECT * EXCLUDE (p0, n, s, e), (CASE WHEN s > 0 THEN '…' ELSE '' END) || substring(text, s + 1, e - s) || (CASE WHEN e < n THEN '…' ELSE '' END) AS excerpt FROM {name}_e)"""


def _tables(spark, d):
    """Chunks, files, vectors, links of gather()."""
    chunks = _chunks(spark, d)
    return chunks, chunks, model.embeddings(spark, d), model.outlinks(spark, d)


def _pinned(spark, d):
    """What a session pinned: the last 20 files that are labelled good."""
    good = model.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("file_id")).orderBy(F.desc("file_id")).limit(20)
    return model.files(spark, d).join(good, "file_id", "left_semi").select("rel_path", F.lit(0).cast("long").alias("start_byte"), F.col("size_bytes").alias("end_byte"), F.col("file_id").alias("pos"))


def _hits(spark, d) -> DataFrame:
    """The 40 best hits of the hybrid search and the 20 newest of their neighbours."""
    return jobs.gather(*_tables(spark, d), PHRASE, VECTOR, top_k=40, expand=20).withColumn("score", F.round("score", 9))


def _hits_sql(k: int, expand: int, pinned: int = 0) -> str:
    pins = "" if not pinned else f" UNION ALL SELECT f.*, 0.0::DOUBLE, false, 2 FROM files f WHERE file_id IN (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id DESC LIMIT {pinned})"
    return f"""{model.with_sql("files", "outlinks")}, {_ranked_sql("0::DOUBLE", k)}, {_NEAR},
        fresh AS (SELECT * FROM files WHERE file_id IN (SELECT file_id FROM near) AND file_id NOT IN (SELECT file_id FROM ranked) ORDER BY mtime_ns DESC, rel_path LIMIT {expand}),
        parts AS (SELECT f.*, round(r.score, 9) AS score, false AS expanded_context, 0 AS part FROM files f JOIN ranked r ON r.file_id = f.file_id
            UNION ALL SELECT fresh.*, 0.0::DOUBLE, true, 1 FROM fresh{pins}), {_excerpt_sql(PHRASE, 400, 80, 320, "parts", "found")},
        hits AS (SELECT *, 0::BIGINT AS start_byte, size_bytes AS end_byte FROM found)"""


_HITS = _hits_sql(40, 20)


def _temporal(mode, **how):
    def query(spark, d):
        rows = ask.temporal(_hits(spark, d), mode, **how)
        return rows.select(F.col("rank").cast("long").alias("rank"), "file_id", F.col("age_days").cast("long").alias("age_days"), "note_type", F.round("temporal_score", 6).alias("temporal_score"))

    return query


def _aged_sql(mode: str, window: int | None) -> str:
    """Common table expressions from hits to timed: with age, type, score t and rank."""
    weight = "0.0" if mode == "all" else "CASE WHEN contains(rel_path, '/journal/') THEN 0.2 ELSE 0.04 END"
    keep = "" if window is None else f"WHERE age_days <= {window} OR NOT (SELECT bool_or(age_days <= {window}) FROM aged)"
    return f"""aged AS (SELECT *, greatest(date_diff('day', effective_date::DATE, max(effective_date::DATE) OVER ()), 0)::BIGINT AS age_days FROM hits),
        weighed AS (SELECT *, CASE WHEN contains(rel_path, '/journal/') THEN 'journal' ELSE 'evergreen' END AS note_type,
            score + ({weight})::DOUBLE * exp(-ln(2.0::DOUBLE) * age_days / 30.0::DOUBLE) AS t FROM aged {keep}),
        timed AS (SELECT *, row_number() OVER (ORDER BY expanded_context, round(t, 9) DESC, mtime_ns DESC, rel_path, start_byte, end_byte) AS rank FROM weighed)"""


def _temporal_sql(mode: str, window: int | None) -> str:
    return f"{_HITS}, {_aged_sql(mode, window)} SELECT rank, file_id, age_days, note_type, round(t, 6) AS temporal_score FROM timed"


def _by_source(spark, d):
    """The hits with their folder as the path, so that files have several spans, some of them twice."""
    folder = F.element_at(F.split("rel_path", "/"), -2)
    rows = _hits(spark, d).withColumn("rel_path", folder).withColumn("end_byte", F.col("file_id") % 7)
    return rows.withColumn("rank", F.row_number().over(search.Window.orderBy(F.desc("score"), "file_id")))


def rerank_dedupe_cap(spark, d):
    return ask.rerank(_by_source(spark, d), 3, True).select(F.col("rank").cast("long").alias("rank"), "rel_path", "file_id", "end_byte")


def _pack(budget):
    def query(spark, d):
        rows = _hits(spark, d).withColumn("rank", F.row_number().over(search.Window.orderBy(F.desc("score"), "file_id")))
        return ask.pack(rows, budget).select(F.col("rank").cast("long").alias("rank"), "file_id", "cost", "used")

    return query


_COST = "(length(excerpt) + length(title) + length(heading_path) + 64)::BIGINT AS cost"


def _pack_sql(budget: int) -> str:
    return f"""{_HITS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS rank, {_COST} FROM hits),
        u AS (SELECT *, (sum(cost) OVER (ORDER BY rank))::BIGINT AS used FROM r)
        SELECT rank, file_id, cost, used FROM u WHERE used <= {budget} OR EXISTS (SELECT 1 FROM u e WHERE e.used = {budget} AND e.rank < u.rank)"""


def ask_answer(spark, d):
    rows = ask.rerank(ask.temporal(_hits(spark, d), "hybrid"), 3)
    return ask.answer(ask.pack(rows, 4000), " What of it? ")


_ANSWER = f"""{_HITS}, {_aged_sql("hybrid", None)},
    u AS (SELECT *, {_COST}, (sum(cost) OVER (ORDER BY rank))::BIGINT AS used FROM timed),
    p AS (SELECT * FROM u WHERE used <= 4000)
    SELECT 'Q: What of it?' || chr(10) || chr(10) || 'Evidence (excerpts):' || chr(10)
        || string_agg(rank || '. ' || effective_date || ' · ' || title || ' · ' || heading_path || chr(10) || rtrim('   ' || excerpt, ' ') || chr(10) || '   [' || rel_path || ':0-' || size_bytes || ']', chr(10) ORDER BY rank)
        || chr(10) || chr(10) || 'Citations:' || chr(10) || string_agg('- ' || rel_path || ':0-' || size_bytes, chr(10) ORDER BY rank) || chr(10) AS answer FROM p"""


def ask_pipeline(spark, d):
    """The whole question: hits, neighbours and pins, in temporal order, deduped, capped and packed."""
    rows = jobs.ask_plan(*_tables(spark, d), PHRASE, VECTOR, _pinned(spark, d), packed_max_chars=6000)
    return rows.select(F.col("rank").cast("long").alias("rank"), "file_id", F.round("temporal_score", 6).alias("temporal_score"), "cost")


_ASK = f"""{_hits_sql(10, 10, 20)}, {_aged_sql("hybrid", None)},
    once AS (SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY rel_path, start_byte, end_byte ORDER BY rank) = 1),
    u AS (SELECT * REPLACE (row_number() OVER (ORDER BY rank) AS rank), {_COST} FROM once),
    v AS (SELECT *, (sum(cost) OVER (ORDER BY rank))::BIGINT AS used FROM u)
    SELECT rank, file_id, round(t, 6) AS temporal_score, cost FROM v WHERE used <= 6000"""


def session_pins_join(spark, d):
    """All labelled files as pins, the bad ones with a span that isn't there."""
    labels = model.table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    pinned = model.files(spark, d).join(labels, "file_id").select("rel_path", F.lit(0).cast("long").alias("start_byte"), F.when(F.col("quality") == 1, F.col("size_bytes")).otherwise(-1).cast("long").alias("end_byte"), F.col("file_id").alias("pos"))
    return ask.pins(_chunks(spark, d), pinned).select("pos", "rel_path", "end_byte", "content_hash")


def weighted_mean_vector(spark, d):
    rows = model.embeddings(spark, d).withColumn("w", F.col("file_id") % 5 + 1)
    return weighted_mean(rows, ["model"], "vector", "w").select("model", F.posexplode("mean").alias("pos", "x")).select("model", "pos", F.round("x", 6).alias("x"))


def sha_embed_text(spark, d):
    rows = model.files(spark, d).select("file_id", F.posexplode(hash_embedding(F.col("text"), 12)).alias("pos", "x"))
    return rows.select("file_id", "pos", F.round("x", 9).alias("x"))


def representative_vectors(spark, d):
    """Cosine of each vector with the mean of its model's vectors: outliers first by rank within the model."""
    from ..functions.vectors import cosine

    rows = model.embeddings(spark, d)
    mean = weighted_mean(rows.withColumn("w", F.lit(1.0)), ["model"], "vector", "w")
    return rows.join(mean, "model").select("file_id", "model", F.round(cosine(F.col("vector"), F.col("mean")), 6).alias("cosine"))


_F, _T = model.with_sql("files"), model.with_sql("file_tags")
QUERIES = {
    "fts_bm25_phrase_topk": (fts_bm25_phrase_topk, f"{_F}, {_BM25} SELECT file_id, rel_path, hits, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm.bm25, 9), mtime_ns DESC, rel_path LIMIT 20"),
    "vector_cosine_topk": (vector_cosine_topk, f"WITH {_COS} SELECT file_id, round(cosine, 6) AS cosine FROM cos ORDER BY round(cos.cosine, 9) DESC, file_id LIMIT 20"),
    "vector_topk_allowlist": (vector_topk_allowlist, f"WITH {_COS} SELECT file_id, round(cosine, 6) AS cosine FROM cos WHERE file_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY round(cos.cosine, 9) DESC, file_id LIMIT 20"),
    "hybrid_fusion_topk": (hybrid_fusion_topk, _hybrid_sql("0::DOUBLE", "rank, file_id, rel_path, round(score, 6) AS score, round(lex_norm, 6) AS lex_norm, round(vec_norm, 6) AS vec_norm")),
    "hybrid_prefer_recent": (hybrid_prefer_recent, _hybrid_sql("0.15::DOUBLE * exp(-ln(2.0::DOUBLE) * greatest(date_diff('day', effective_date::DATE, DATE '2024-01-31'), 0) / 30.0::DOUBLE)", "rank, file_id, effective_date, round(score, 6) AS score")),
    "tag_filter_or": (tag_filter_or, f"{_T} SELECT DISTINCT file_id FROM file_tags WHERE name IN ('de', 'toxic')"),
    "tag_filter_and": (tag_filter_and, f"{_T} SELECT file_id FROM file_tags WHERE name IN ('en', 'quality') GROUP BY file_id HAVING count(DISTINCT name) = 2"),
    "effective_date_range": (effective_date_range, f"{_F} SELECT file_id, rel_path, effective_date FROM files WHERE effective_date BETWEEN '2024-01-05' AND '2024-01-12'"),
    "allowed_chunks_under_filters": (allowed_chunks_under_filters, f"{_F} SELECT file_id, content_hash FROM files WHERE lang = 'en' AND effective_date >= '2024-01-03' AND effective_date <= '2024-01-20'"),
    "link_neighbors_1hop": (link_neighbors_1hop, f"{model.with_sql('files', 'outlinks')}, {_ranked_sql('0::DOUBLE', 10)}, {_NEAR} SELECT file_id, rel_path, effective_date, 0.0::DOUBLE AS score, true AS expanded_context FROM files WHERE file_id IN (SELECT file_id FROM near) AND file_id NOT IN (SELECT file_id FROM ranked) ORDER BY mtime_ns DESC, rel_path LIMIT 25"),
    "neighbor_representative_chunk": (neighbor_representative_chunk, f"{model.with_sql('files', 'outlinks', 'lines')}, {_ranked_sql('0::DOUBLE', 10)}, {_NEAR} SELECT file_id, line, start_byte, end_byte FROM lines WHERE text != '' AND file_id IN (SELECT file_id FROM near) AND file_id NOT IN (SELECT file_id FROM ranked) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY (line = 2) DESC, line) = 1"),
    "excerpt_window": (excerpt_window, f"{_F}, {_excerpt_sql(PHRASE, 200, 40, 160, 'files', 'x')} SELECT file_id, excerpt FROM x"),
    "temporal_hybrid": (_temporal("hybrid"), _temporal_sql("hybrid", None)),
    "temporal_recent_window": (_temporal("recent"), _temporal_sql("recent", 7)),
    "temporal_all": (_temporal("all"), _temporal_sql("all", None)),
    "temporal_window_fallback": (_temporal("recent", windows={"recent": 0}), _temporal_sql("recent", 0)),
    "rerank_dedupe_cap": (rerank_dedupe_cap, f"""{_HITS}, r AS (SELECT string_split(rel_path, '/')[-2] AS rel_path, file_id, file_id % 7 AS end_byte, row_number() OVER (ORDER BY score DESC, file_id) AS rank, expanded_context FROM hits),
        a AS (SELECT * FROM r WHERE NOT expanded_context QUALIFY row_number() OVER (PARTITION BY rel_path, end_byte ORDER BY rank) = 1),
        b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY rank) <= 3)
        SELECT row_number() OVER (ORDER BY rank) AS rank, rel_path, file_id, end_byte FROM b"""),
    "pack_budget": (_pack(3000), _pack_sql(3000)),
    "pack_unlimited": (_pack(0), _pack_sql(1_000_000_000)),
    "ask_answer": (ask_answer, _ANSWER),
    "ask_pipeline": (ask_pipeline, _ASK),
    "fts_index_build": (fts_index_build, _token_sql("")),
    "fts_index_update": (fts_index_update, _token_sql("WHERE file_id % 6 != 3")),
    "fts_index_search": (fts_index_search, f"{_F}, {_BM25.replace('FROM files)', 'FROM files WHERE file_id % 6 != 3)', 1)} SELECT file_id, rel_path, hits, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm.bm25, 9), mtime_ns DESC, rel_path LIMIT 20"),
    "fts_segments_search": (fts_segments_search, f"{_F}, {_BM25.replace('FROM files)', 'FROM files WHERE file_id % 6 != 3)', 1)} SELECT file_id, rel_path, hits, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm.bm25, 9), mtime_ns DESC, rel_path LIMIT 20"),
    "session_pins_join": (session_pins_join, f"{_F} SELECT file_id AS pos, rel_path, size_bytes AS end_byte, content_hash FROM files JOIN labels ON doc_id = file_id WHERE quality = 1"),
    "weighted_mean_vector": (weighted_mean_vector, "WITH e AS (SELECT label AS model, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos, vec_id % 5 + 1 AS w FROM embeddings) SELECT model, pos::INT AS pos, round(sum(v * w) / sum(w), 6) AS x FROM e GROUP BY model, pos"),
    "sha_embed_text": (sha_embed_text, f"""{_F}, b AS (SELECT file_id, sha256(from_hex('00000000') || encode(text)) AS h0, sha256(from_hex('01000000') || encode(text)) AS h1 FROM files),
        p AS (SELECT file_id, unnest(range(0, 12)) AS pos, h0, h1 FROM b),
        s AS (SELECT file_id, pos, (CASE WHEN pos < 8 THEN h0 ELSE h1 END) AS h, ((pos % 8) * 8 + 1)::INT AS k FROM p)
        SELECT file_id, pos::INT AS pos, round(('0x' || substring(h, k + 6, 2) || substring(h, k + 4, 2) || substring(h, k + 2, 2) || substring(h, k, 2))::BIGINT / 4294967295.0::DOUBLE * 2 - 1, 9) AS x FROM s"""),
    "representative_vectors": (representative_vectors, """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
        m AS (SELECT label, pos, avg(v) AS mean FROM e GROUP BY label, pos)
        SELECT vec_id AS file_id, label AS model, round(sum(v * mean) / (sqrt(sum(v * v)) * sqrt(sum(mean * mean))), 6) AS cosine FROM e JOIN m USING (label, pos) GROUP BY vec_id, label"""),
}
