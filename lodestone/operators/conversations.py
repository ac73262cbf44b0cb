"""Conversations: chat exports of several shapes, hashes, routing state, transcripts, daily blocks, stable note paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .naming import deal_names

LISTS = ("conversations", "data", "chats", "messages", "conversations_list", "chat_list")


def _first(v: str, keys: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the keys with a value that isn't blank."""
    return F.expr("coalesce(" + ", ".join(f"nullif(try_variant_get({v}, '$.{k}', '{kind}'), '')" for k in keys) + ")")


def _time(v: str, keys: tuple[str, ...]) -> Column:
    """The first of the keys that is an epoch in seconds or a timestamp as text, in UTC."""
    def one(k: str) -> str:
        text = f"nullif(try_variant_get({v}, '$.{k}', 'string'), '')"
        return f"coalesce(timestamp_micros(cast(try_cast({text} as double) * 1000000 as bigint)), try_to_timestamp({text}))"

    return F.expr("coalesce(" + ", ".join(map(one, keys)) + ")")


def export_conversations(exports: DataFrame, json: str = "value") -> DataFrame:
    """One variant column, conv, for each conversation of each export: a list, a keyed list, a map of them, or a single one. Bad JSON gives none."""
    v = exports.select(F.expr(f"try_parse_json({json})").alias("v")).filter("v is not null")
    keyed = "coalesce(" + ", ".join(f"try_variant_get(v, '$.{k}', 'array<variant>')" for k in LISTS[:3] + LISTS[4:]) + ")"
    whole = "coalesce(try_cast(v as array<variant>), " + keyed + ", map_values(try_variant_get(v, '$.conversations', 'map<string,variant>')), array(v))"
    return v.select(F.explode(F.expr(whole)).alias("conv"))


def normalise(conversations: DataFrame, conv: str = "conv") -> DataFrame:
    """conversation_id, title, created_at, updated_at, messages (role, content, created_at) of variants.

    Messages are those of user and assistant that aren't blank, with a time first, by time, else in their order. Without an
    id, the first 16 hex digits of the MD5 of title and time stand for it; without these either the row is dropped.
    """
    df = conversations.select(F.col(conv).alias("c"))
    title, raw_time = "coalesce(try_variant_get(c, '$.title', 'string'), '')", "coalesce(try_variant_get(c, '$.create_time', 'string'), try_variant_get(c, '$.created_at', 'string'), '')"
    made = F.expr(f"case when {title} != '' or {raw_time} != '' then substring(md5(cast(concat({title}, '_', {raw_time}) as binary)), 1, 16) end")
    nodes = "coalesce(transform(map_values(try_variant_get(c, '$.mapping', 'map<string,variant>')), n -> try_variant_get(n, '$.message', 'variant')), " + ", ".join(f"try_variant_get(c, '$.{k}', 'array<variant>')" for k in ("messages", "message", "turns", "history")) + ", cast(array() as array<variant>))"
    out = df.select(
        F.coalesce(_first("c", ("id", "conversation_id", "chat_id", "uuid")), made).alias("conversation_id"),
        F.coalesce(F.nullif(F.trim(_first("c", ("title", "name", "subject"))), F.lit("")), F.lit("Untitled Conversation")).alias("title"),
        _time("c", ("create_time", "created_at", "created", "timestamp")).alias("created_at"),
        _time("c", ("update_time", "updated_at", "modified_at")).alias("updated"),
        F.expr(f"filter({nodes}, m -> m is not null)").alias("raw"),
    ).filter("conversation_id is not null")
    role = "lower(coalesce(try_variant_get(m, '$.role', 'string'), try_variant_get(m, '$.author.role', 'string'), try_variant_get(m, '$.author', 'string'), try_variant_get(m, '$.sender', 'string')))"
    content = "trim(coalesce(array_join(try_variant_get(m, '$.content.parts', 'array<string>'), '\\n'), try_variant_get(m, '$.content.text', 'string'), array_join(try_variant_get(m, '$.parts', 'array<string>'), '\\n'), try_variant_get(m, '$.content', 'string'), try_variant_get(m, '$.text', 'string'), try_variant_get(m, '$.message', 'string'), ''))"
    text = "nullif(coalesce(" + ", ".join(f"try_variant_get(m, '$.{k}', 'string')" for k in ("create_time", "update_time", "timestamp", "time", "created_at")) + "), '')"
    at = f"coalesce(timestamp_micros(cast(try_cast({text} as double) * 1000000 as bigint)), try_to_timestamp({text}))"
    shaped = F.expr(f"transform(raw, (m, i) -> named_struct('none', {at} is null, 'at', {at}, 'i', i, 'role', {role}, 'content', {content}))")
    kept = F.filter(shaped, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
    messages = F.transform(F.array_sort(kept), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["at"].alias("created_at")))
    out = out.withColumn("messages", messages)
    earliest = F.array_min(F.transform("messages", lambda m: m["created_at"]))
    return out.select("conversation_id", "title", F.coalesce("created_at", "updated", earliest).alias("created_at"), F.coalesce("updated", "created_at", earliest).alias("updated_at"), "messages")


def conversation_rows(messages: DataFrame) -> DataFrame:
    """conv_id, title (40 characters of the first turn), text, n_messages, mean_chars of messages (conv_id, turn, role, content)."""
    kept = messages.filter(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    turns = F.array_sort(F.collect_list(F.struct("turn", "content")))
    rows = kept.groupBy("conv_id").agg(turns.alias("t"), F.count(F.lit(1)).alias("n_messages"), F.avg(F.char_length(F.trim("content"))).alias("mean_chars"))
    return rows.select("conv_id", F.substring(F.col("t")[0]["content"], 1, 40).alias("title"), F.array_join(F.transform("t", lambda x: x["content"]), "\n").alias("text"), "n_messages", "mean_chars")


def content_hashes(messages: DataFrame) -> DataFrame:
    """(conv_id, content_hash): SHA-256 of id, title and, turn by turn, role and content, joined by bars."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    g = messages.groupBy("conv_id").agg(rows.alias("t"))
    body = F.flatten(F.transform("t", lambda x: F.array(x["role"], x["content"])))
    return g.select("conv_id", F.sha2(F.array_join(F.concat(F.array(F.col("conv_id").cast("string"), F.substring(F.col("t")[0]["content"], 1, 40)), body), "|"), 256).alias("content_hash"))


def changed_notes(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """Conversations whose note is new or whose content has changed."""
    s = stored.select("conv_id", F.col("content_hash").alias("old"))
    return hashes.join(s, "conv_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old"))).drop("old")


def note_paths(notes: DataFrame, folder: str, title: str, order: list[str], bucket: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """notes with path: folder/title.md, then title-2.md, title-3.md, the first that neither an earlier note nor a taken file (file_name: its path) has; see deal_names()."""
    rows = notes.withColumn("__title", F.concat(folder, F.lit("/"), title))
    return deal_names(rows, "__title", F.lit(".md"), order, taken, "-", 2, "path", bucket).drop("__title")


def new_segments(segments: DataFrame, written: DataFrame) -> DataFrame:
    """Segments whose id isn't written yet, each id once."""
    return segments.dropDuplicates(["segment_id"]).join(written.select("segment_id"), "segment_id", "left_anti")


def written_segments(notes: DataFrame, text: str = "text") -> DataFrame:
    """segment_id scraped from the comments of transcript notes."""
    ids = F.regexp_extract_all(F.col(text), F.lit(r"<!--\s*segment_id:\s*(\S+?)\s*-->"), F.lit(1))
    return notes.select(F.explode(ids).alias("segment_id")).distinct()


def daily_rollup(items: DataFrame, day: Column, order: str, lists: list[str]) -> DataFrame:
    """(day, n, and each of the lists): distinct values of each day in order of their first appearance, joined by commas."""
    first = [items.select(day.alias("day"), F.lit(k).alias("k"), F.col(c).alias("v"), F.col(order).alias("o")) for k, c in enumerate(lists)]
    one = reduce(DataFrame.unionByName, first).filter("v is not null").groupBy("day", "k", "v").agg(F.min("o").alias("o"))
    rows = one.groupBy("day").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("o", "v")))), lambda x: x["v"]), ",").alias(c) for k, c in enumerate(lists)])
    return items.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).join(rows, "day", "left")


def sanitise_action(item: Column) -> Column:
    """One line without list marks or boxes."""
    flat = F.regexp_replace(item, r"[\r\n]+", " ")
    return F.trim(F.regexp_replace(flat, r"^\s*(?:[-*•]\s*)?(?:\[[ xX]?\]\s*)?", ""))


def marker_count(text: Column, marker: str) -> Column:
    escaped = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in marker)
    return (F.size(F.split(text, escaped)) - 1).cast("long")


def replace_block(notes: DataFrame, start: str, end: str, block: Column, text: str = "text") -> DataFrame:
    """notes with the marked block replaced, and how: new (appended), existing (replaced), recovered (marks amiss: all removed, then appended)."""
    value = F.coalesce(F.col(text), F.lit(""))
    a, b = marker_count(value, start), marker_count(value, end)
    ordered = F.instr(value, start) < F.instr(value, end)
    status = F.when((a == 0) & (b == 0), "new").when((a == 1) & (b == 1) & ordered, "existing").otherwise("recovered")
    whole = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    before = F.substring_index(value, start, 1)
    after = F.substring_index(value, end, -1)
    pattern = r"(?s)\Q" + start + r"\E.*?\Q" + end + r"\E"
    bare = F.replace(F.replace(F.regexp_replace(value, pattern, ""), F.lit(start), F.lit("")), F.lit(end), F.lit(""))
    append = lambda x: F.concat(F.rtrim(F.regexp_replace(x, r"\s+$", "")), F.lit("\n\n"), whole, F.lit("\n"))
    return notes.withColumn("status", status).withColumn(text, F.when(F.col("status") == "new", append(value)).when(F.col("status") == "existing", F.concat(before, whole, after)).otherwise(append(bare)))


def daily_lines(items: DataFrame, paths: DataFrame, metadata: DataFrame, questions: bool = True) -> DataFrame:
    """(day, block): the lines that a day's note gets for its conversations, by time: a link to each note, its signpost and first open question if there are any.

    items: conversation_id, day, created_at, title; paths: conversation_id, path; metadata: conversation_id, signpost, partial, open_questions.
    A conversation without a path links to its title. One line list for each day, as long as the day's note.
    """
    rows = items.join(paths, "conversation_id", "left").join(metadata, "conversation_id", "left")
    target = F.regexp_replace(F.coalesce("path", "title"), r"\.md$", "")
    flat = lambda c: F.trim(F.regexp_replace(c, "\n", " "))
    sign = F.when(F.coalesce("signpost", F.lit("")) != "", F.concat(F.lit("\n  - "), flat(F.col("signpost")), F.when(F.col("partial"), " ⏳").otherwise("")))
    asked = F.when(F.lit(questions) & (F.size(F.coalesce("open_questions", F.array().cast("array<string>"))) > 0), F.concat(F.lit("\n  - Q: "), flat(F.get("open_questions", F.lit(0)))))
    line = F.concat(F.lit("- [["), target, F.lit("]]"), F.coalesce(sign, F.lit("")), F.coalesce(asked, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "conversation_id", line.alias("x"))))
    return rows.groupBy("day").agg(F.array_join(F.transform(ordered, lambda r: r["x"]), "\n").alias("block"))


def without_links(notes: DataFrame, targets: DataFrame, start: str, end: str) -> DataFrame:
    """(path, text) of the notes whose marked block links to one of the targets (target): without these lines and the indented ones below them.

    Lines and links are rows, so neither a long note nor a long list of targets meets in one place but the note's own text.
    """
    marked = notes.filter((F.instr("text", start) > 0) & (F.instr("text", end) > F.instr("text", start)))
    cut = marked.select("path", F.substring_index("text", start, 1).alias("before"), F.regexp_extract("text", r"(?s)\Q" + start + r"\E(.*?)\Q" + end + r"\E(.*)", 1).alias("block"), F.regexp_extract("text", r"(?s)\Q" + start + r"\E(.*?)\Q" + end + r"\E(.*)", 2).alias("after"))
    lines = cut.select("path", F.posexplode(F.split("block", "\n")).alias("i", "line"))
    links = lines.select("path", "i", F.explode(F.regexp_extract_all("line", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("link"))
    hit = links.withColumn("target", F.trim(F.substring_index("link", "|", 1))).join(targets.select("target").distinct(), "target", "left_semi").select("path", "i").distinct().withColumn("hit", F.lit(True))
    own = lines.join(hit, ["path", "i"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    # An indented line goes with the nearest line above that isn't indented or that links itself.
    lead = F.when(~F.col("line").startswith("  - ") | F.col("hit"), F.col("hit"))
    own = own.withColumn("gone", F.coalesce(F.last(lead, ignorenulls=True).over(Window.partitionBy("path").orderBy("i")), F.lit(False)))
    kept = own.groupBy("path").agg(F.max("gone").alias("any"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("i", "line")))), lambda x: x["line"]), "\n").alias("lines"))
    return kept.filter("any").join(cut, "path").select("path", F.concat("before", F.lit(start), "lines", F.lit(end), "after").alias("text"))
