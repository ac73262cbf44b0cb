"""Retrieval: filters, phrase BM25, exact cosine, fusion, link expansion. Every ranked result has a total order."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective_date, excerpt, phrase_count, query_tokens, token_count, tokens
from ..functions.vectors import dot, literal, norm

if TYPE_CHECKING:
    from .textindex import TextIndex

#: Constants of BM25.
K1, B = 1.2, 0.75


def normalise_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(tag, "^#+", ""))


def with_tags(file_tags: DataFrame, tags: list[str], every: bool) -> DataFrame:
    """file_id of the files with any, or every, of the tags; a tag named twice counts once."""
    wanted = sorted({t.strip().lstrip("#").strip() for t in tags} - {""})
    hit = file_tags.filter(F.col("name").isin(wanted)).select("file_id", "name")
    if not every:
        return hit.select("file_id").distinct()
    return hit.groupBy("file_id").agg(F.countDistinct("name").alias("n")).filter(F.col("n") == len(wanted)).select("file_id")


def dated(files: DataFrame) -> DataFrame:
    return files.withColumn("effective_date", effective_date(F.col("fm_journal_date"), F.col("mtime_ns")))


def in_dates(files: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Files whose effective date is in the range, both ends included."""
    out = dated(files)
    out = out.filter(F.col("effective_date") >= first) if first else out
    return out.filter(F.col("effective_date") <= last) if last else out


def allowed(files: DataFrame, file_tags: DataFrame, tags: list[str] | None = None, every: bool = True, first: str | None = None, last: str | None = None) -> DataFrame:
    """Files that pass tags and dates. No tags named: any file; tags that nobody has: none."""
    out = in_dates(files, first, last)
    return out.join(with_tags(file_tags, tags, every), "file_id", "left_semi") if tags else out


def bm25_score(n: Column, mean: Column, df: Column, hits: Column, length: Column) -> Column:
    """Lower is better: n chunks of `mean` tokens, df of them with the phrase; a chunk of `length` tokens that has it `hits` times."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return -idf * hits * (K1 + 1) / (hits + K1 * ((1 - B) + B * length / mean))


def _measure(query: str, columns: tuple[str, ...]) -> Column:
    """(d, tf): tokens of the columns, places of the phrase in them."""
    phrase = query_tokens(query)
    # One fold over the columns' tokens: a lambda's variable is computed once, however often it is used.
    zero = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("tf"))
    return F.aggregate(F.array(*[tokens(F.col(c)) for c in columns]), zero, lambda s, w: F.struct((s["d"] + token_count(w)).alias("d"), (s["tf"] + phrase_count(w, phrase)).alias("tf")))


def _ranked(counts: DataFrame) -> DataFrame:
    """counts (d, tf) with hits and bm25, null where the phrase is not; the statistics are a scalar subquery of one row."""
    stats = counts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.count_if(F.col("tf") > 0).alias("df")).alias("stats"))
    rows = counts.withColumn("stats", stats.scalar())
    score = bm25_score(F.col("stats.n"), F.col("stats.mean"), F.col("stats.df"), F.col("tf"), F.col("d"))
    return rows.withColumn("bm25", F.when(F.col("tf") > 0, score)).withColumnRenamed("tf", "hits").drop("d", "stats")


def bm25(chunks: DataFrame, query: str, columns: tuple[str, ...] = ("heading_path", "text")) -> DataFrame:
    """chunks whose columns hold the query as one phrase, with bm25 (lower is better) and hits.

    Statistics (number of chunks, their mean length in tokens, chunks with the phrase) cover all chunks. A query without
    tokens matches nothing. The texts are read twice, for the statistics and for the matches: see bm25_topk() and TextIndex.
    """
    measured = chunks.withColumn("m", _measure(query, columns)).withColumns({"d": F.col("m.d"), "tf": F.col("m.tf")}).drop("m")
    return _ranked(measured).filter("hits > 0")


def bm25_topk(chunks: DataFrame, query: str, k: int, key: str = "file_id", columns: tuple[str, ...] = ("heading_path", "text")) -> DataFrame:
    """(key, mtime_ns, rel_path, start_byte, hits, bm25) of the k best chunks, in order; ties go to the newest, then by path and place.

    Texts are read once: only counts and these columns are shuffled, and statistics and ranking share that shuffle, as
    what it deals by are all the columns that either uses, and no filter stands between them.
    """
    ties = [key, "mtime_ns", "rel_path", "start_byte"]
    counts = chunks.select(*ties, _measure(query, columns).alias("m")).select(*ties, "m.d", "m.tf").repartition(*ties)
    best = _ranked(counts).orderBy(F.asc_nulls_last(F.round("bm25", 9)), F.desc("mtime_ns"), "rel_path", "start_byte").limit(k)
    return best.filter("bm25 is not null")


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "file_id", vector: str = "vector") -> DataFrame:
    """The k rows of the largest cosine with the query, ties by key; rows of norm 0 are skipped, a query of norm 0 finds none."""
    q = literal(query)
    size = sum(float(x) ** 2 for x in query) ** 0.5
    scored = vectors.select(key, (dot(F.col(vector), q) / (norm(F.col(vector)) * F.lit(size))).alias("cosine"), norm(F.col(vector)).alias("length"))
    if not size:
        scored = scored.limit(0)
    return scored.filter("length > 0").drop("length").orderBy(F.desc(F.round("cosine", 9)), key).limit(k)


def min_max(value: Column) -> Column:
    """The value's place between the smallest and largest of all rows that have one; 1 where they are the same. For results of bounded size."""
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min(value).over(everything), F.max(value).over(everything)
    return F.when(value.isNotNull(), F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low)))


def order_of_hits() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.desc("mtime_ns"), F.asc("rel_path"), F.asc("start_byte")]


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10, lexical: float = 0.5, semantic: float = 0.5, as_of: str | None = None, half_life: float = 30.0, recency: float = 0.15, index: TextIndex | None = None) -> DataFrame:
    """The top k chunks by the weighted sum of both legs, each cut at 5 k rows and scaled to 0..1; rank from 1.

    chunks: file_id, rel_path, title, heading_path, text, mtime_ns, fm_journal_date, start_byte, end_byte. With as_of, a
    decaying boost is added for recent files. Only the two legs read the corpus; what follows has 10 k rows at most. With a
    text index, its postings stand in for the texts, and chunks need no text; without it there is no excerpt.
    """
    best = index.topk(query, 5 * k) if index else bm25_topk(chunks, query, 5 * k)
    lex = best.select("file_id", (-F.col("bm25")).alias("lex"))
    vec = cosine_topk(vectors.join(chunks.select("file_id"), "file_id", "left_semi"), vector, 5 * k)
    both = lex.join(vec, "file_id", "full_outer")
    scaled = both.select("file_id", F.coalesce(min_max(F.col("lex")), F.lit(0.0)).alias("lex_norm"), F.coalesce(min_max(F.col("cosine")), F.lit(0.0)).alias("vec_norm"))
    found = dated(chunks).join(F.broadcast(scaled), "file_id")  # 10 k rows
    score = lexical * F.col("lex_norm") + semantic * F.col("vec_norm")
    if as_of and recency > 0 and half_life > 0:
        age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.col("effective_date").cast("date")), F.lit(0))
        score = score + recency * F.exp(-F.log(F.lit(2.0)) * age / half_life)
    top = found.withColumn("score", score).orderBy(*order_of_hits()).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order_of_hits())))
    return ranked.withColumn("excerpt", excerpt(F.col("text"), query)) if "text" in chunks.columns else ranked


def neighbours(primary: DataFrame, files: DataFrame, outlinks: DataFrame) -> DataFrame:
    """Files one link away from the primary files (file_id, title), in either direction, themselves left out.

    How many primary files there are is not known here, so nothing is broadcast by hint; the planner does it where sizes allow.
    """
    seeds = primary.select(F.col("file_id").alias("seed"), F.col("title").alias("seed_title"))
    back = outlinks.join(seeds, F.col("target") == F.col("seed_title"), "left_semi").select("file_id")
    targets = outlinks.join(seeds, F.col("file_id") == F.col("seed"), "left_semi").select("target").distinct()
    forward = files.join(targets, files["title"] == F.col("target"), "left_semi").select("file_id")
    return back.union(forward).distinct().join(seeds, F.col("file_id") == F.col("seed"), "left_anti")


def expand_links(hits: DataFrame, files: DataFrame, outlinks: DataFrame, cap: int = 10, first: str | None = None, last: str | None = None) -> DataFrame:
    """The newest `cap` neighbours of the hits, as rows of score 0 that follow them."""
    near = in_dates(files, first, last).join(neighbours(hits, files, outlinks), "file_id", "left_semi")
    return near.orderBy(F.desc("mtime_ns"), "rel_path").limit(cap).withColumn("score", F.lit(0.0)).withColumn("expanded_context", F.lit(True))


def representative_chunk(chunks: DataFrame, preferred: Column | None = None) -> DataFrame:
    """One chunk of each file: the preferred line if it has it, else the first."""
    order = [F.desc(F.col("line") == preferred)] if preferred is not None else []
    w = Window.partitionBy("file_id").orderBy(*order, "line", "start_byte")
    return chunks.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
