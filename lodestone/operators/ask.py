"""Asking: the temporal layer, dedupe and cap, packing under a budget, the answer's lines. For hits of bounded number (top k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decay, note_type

# Days that each mode looks back.
WINDOW_DAYS = {"recent": 7, "month": 30, "year": 180, "all": None, "hybrid": None}


def _order() -> list[Column]:
    return [F.asc("expanded_context"), F.desc(F.round("temporal_score", 9)), F.desc("mtime_ns"), F.asc("rel_path"), F.asc("start_byte"), F.asc("end_byte")]


def temporal(hits: DataFrame, mode: str = "hybrid", half_life: float = 30.0, journal: float = 0.2, evergreen: float = 0.04, windows: dict | None = None) -> DataFrame:
    """hits in a new order (rank), with age_days, note_type, boost and temporal_score.

    Ages count from the newest hit. A mode with a window keeps the hits within it, or all if none is. Mode all has no boost.
    """
    days = (WINDOW_DAYS | (windows or {})).get(mode)
    day = F.coalesce(F.expr("try_to_date(effective_date)"), F.to_date(F.timestamp_seconds(F.floor(F.col("mtime_ns") / 1_000_000_000))))
    rows = hits.withColumn("day", day)
    rows = rows.withColumn("age_days", F.greatest(F.datediff(F.max("day").over(Window.partitionBy(F.lit(1))), "day"), F.lit(0)))
    rows = rows.withColumn("note_type", note_type(F.col("rel_path")))
    weight = F.lit(0.0) if mode == "all" else F.when(F.col("note_type") == "journal", journal).otherwise(evergreen)
    rows = rows.withColumn("boost", weight * decay(F.col("age_days"), half_life)).withColumn("temporal_score", F.col("score") + F.col("boost"))
    if days is not None:
        rows = rows.withColumn("within", F.col("age_days") <= max(0, days))
        rows = rows.withColumn("any_within", F.max("within").over(Window.partitionBy(F.lit(1)))).filter(F.col("within") | ~F.col("any_within")).drop("within", "any_within")
    return rows.drop("day").withColumn("rank", F.row_number().over(Window.orderBy(*_order())))


def rerank(hits: DataFrame, per_file: int = 3, drop_expanded: bool = False) -> DataFrame:
    """The first hit (by rank) of each span, then at most `per_file` of each file (0 or less: all); rank anew."""
    rows = hits.filter(~F.col("expanded_context")) if drop_expanded else hits
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("rel_path", "start_byte", "end_byte").orderBy("rank"))).filter("n = 1")
    if per_file > 0:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("rel_path").orderBy("rank"))).filter(F.col("n") <= per_file)
    return rows.drop("n").withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def pack(hits: DataFrame, budget: int = 8000) -> DataFrame:
    """The hits, by rank, that fit the budget of characters; the first that doesn't fit ends it. A budget used up exactly, or none, ends nothing."""
    cost = F.char_length(F.coalesce("excerpt", F.lit(""))) + F.char_length(F.coalesce("title", F.lit(""))) + F.char_length(F.coalesce("heading_path", F.lit(""))) + 64
    rows = hits.withColumn("cost", cost.cast("long")).withColumn("used", F.sum("cost").over(Window.orderBy("rank")))
    if budget <= 0:
        return rows
    exact = F.coalesce(F.max((F.col("used") == budget).cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("after_exact", exact).filter((F.col("used") <= budget) | (F.col("after_exact") == 1)).drop("after_exact")


def citation(rel_path: str = "rel_path", start: str = "start_byte", end: str = "end_byte") -> Column:
    return F.concat(rel_path, F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def answer(packed: DataFrame, query: str) -> DataFrame:
    """One row, answer: the evidence by rank, then the citations."""
    meta = F.concat_ws(" · ", *[F.nullif(F.col(c), F.lit("")) for c in ("effective_date", "title", "heading_path")])
    item = F.concat_ws("\n", F.rtrim(F.concat(F.col("rank").cast("string"), F.lit(". "), meta)), F.rtrim(F.concat(F.lit("   "), "excerpt")), F.concat(F.lit("   ["), citation(), F.lit("]")))
    rows = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"), F.concat(F.lit("- "), citation()).alias("cite"))))
    one = packed.agg(rows.alias("rows"))
    head = f"Q: {query.strip()}\n\n"
    text = F.concat(F.lit(head + "Evidence (excerpts):\n"), F.array_join(F.transform("rows", lambda r: r["item"]), "\n"), F.lit("\n\nCitations:\n"), F.array_join(F.transform("rows", lambda r: r["cite"]), "\n"), F.lit("\n"))
    return one.select(F.when(F.size("rows") == 0, head + "No matches found in the index for this query.\n").otherwise(text).alias("answer"))


def pins(chunks: DataFrame, pinned: DataFrame) -> DataFrame:
    """Chunks that a session pinned, where the span still exists, in the order of the pins (pos)."""
    return chunks.join(pinned, ["rel_path", "start_byte", "end_byte"])


def last_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, by the given descending order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def with_features(hits: DataFrame, timed: DataFrame) -> DataFrame:
    """hits with the temporal features that timed has for their span; of several rows of a span the first by rank counts."""
    span, features = ["rel_path", "start_byte", "end_byte"], ["age_days", "note_type", "boost", "temporal_score"]
    first = timed.groupBy(*span).agg(F.min_by(F.struct(*features), "rank").alias("__f"))
    return hits.drop(*features).join(first, span, "left").select(*[c for c in hits.columns if c not in features], "__f.*")


def candidates() -> Column:
    """The hits of a trace, by rank, each with its score, place and temporal features: one array of at most all hits."""
    row = F.struct("rank", "score", "rel_path", "start_byte", "end_byte", "effective_date", "expanded_context", F.struct("note_type", "age_days", "boost", "temporal_score").alias("time_features"))
    return F.array_sort(F.collect_list(row))


def trace(timed: DataFrame, packed: DataFrame, query: str, settings: dict, ts: str) -> DataFrame:
    """One row (name, value): the JSON record of a question: its settings, candidates, what was packed, its citations. Names end in a hash of query and time."""
    found = timed.agg(candidates().alias("c"))
    used = packed.agg(F.array_sort(F.collect_list(F.struct("rank", "rel_path", "start_byte", "end_byte", "excerpt", "cost"))).alias("p"))
    cited = F.transform("p", lambda x: F.concat(x["rel_path"], F.lit(":"), x["start_byte"].cast("string"), F.lit("-"), x["end_byte"].cast("string")))
    config = F.create_map(*[F.lit(str(x)) for kv in sorted(settings.items()) for x in kv]) if settings else F.lit(None).cast("map<string,string>")
    value = F.to_json(F.struct(F.lit(ts).alias("ts_utc"), F.lit(query).alias("query"), config.alias("ask_config"), F.col("c").alias("candidates"), F.col("p").alias("packed"), cited.alias("citations")))
    suffix = F.substring(F.sha2(F.lit(f"{query}|{ts}"), 256), 1, 12)
    return found.crossJoin(used).select(F.concat(F.lit("ask_" + ts.replace(":", "").replace("-", "") + "_"), suffix, F.lit(".json")).alias("name"), value.alias("value"))
