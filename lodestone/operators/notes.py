"""Note texts as Column expressions: blocks to append, transcripts by day, frontmatter, tolerant JSON of language models."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

BEGIN, CLOSE = "<!-- block:{} begin -->", "<!-- block:{} end -->"
MARKS = {"high": "[HIGH]", "med": "[MED]", "low": "[LOW]"}


def mark(write_id: Column, template: str) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), write_id, F.lit(after))


def _task(t: Column) -> Column:
    level = F.lit("")
    for k, v in MARKS.items():
        level = F.when(t["priority"] == k, v).otherwise(level)
    return F.concat(F.lit("- [ ] "), level, F.lit(" "), t["text"])


def _section(title: str, items: Column) -> Column:
    """A title, the items and a blank line; nothing without items."""
    return let(items, lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(title)), x, F.array(F.lit("")))).otherwise(F.array().cast("array<string>")))


def daily_block(write_id: Column, time: Column, capture_id: Column, summary: Column, key_points: Column, entities: Column, tasks: Column) -> Column:
    """The marked block that a daily note gets for a distilled capture: at most 5 points, 7 entities, 7 tasks."""
    head = F.array(mark(write_id, BEGIN), F.concat(F.lit("### Distilled ("), time, F.lit(" UTC) — "), F.substring(capture_id, 1, 8)), F.lit(""), F.concat(F.lit("**Summary:** "), summary), F.lit(""))
    points = F.transform(F.slice(key_points, 1, 5), lambda p: F.concat(F.lit("- "), p))
    people = F.transform(F.slice(entities, 1, 7), lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ["), e["kind"], F.lit("]")))
    todo = F.transform(F.slice(tasks, 1, 7), _task)
    return F.array_join(F.concat(head, _section("**Key Points:**", points), _section("**Entities:**", people), _section("**Tasks:**", todo), F.array(mark(write_id, CLOSE), F.lit(""))), "\n")


def todo_block(write_id: Column, day: Column, tasks: Column, existing: Column) -> Column:
    """The block of those tasks that the todo text doesn't name yet; null if there are none."""
    def of(fresh: Column) -> Column:
        lines = F.concat(F.array(mark(write_id, BEGIN), F.concat(F.lit("## Draft tasks ("), day, F.lit(")")), F.lit("")), F.transform(fresh, _task), F.array(F.lit(""), mark(write_id, CLOSE), F.lit("")))
        return F.when(F.size(fresh) > 0, F.array_join(lines, "\n"))

    return let(let(F.coalesce(existing, F.lit("")), lambda known: F.filter(F.slice(tasks, 1, 7), lambda t: ~known.contains(t["text"]))), of)


def appended(existing: Column, block: Column, header: str = "") -> Column:
    """The note with the block behind it; a note that isn't there yet begins with the header."""
    return F.when(block.isNull(), existing).when(existing.isNull(), F.concat(F.lit(header), block)).otherwise(F.concat(existing, F.lit("\n"), block))


def transcript_notes(conversations: DataFrame, written: DataFrame) -> DataFrame:
    """(day, text, segments): what each day's transcript note gets of segments not written yet; conversations by start, without new segments none."""
    rows = conversations.select(F.date_format("started_at", "yyyy-MM-dd").alias("day"), "id", "started_at", "finished_at", F.posexplode("segments").alias("i", "s"))
    rows = rows.select("day", "id", "started_at", "finished_at", "i", "s.segment_id", "s.speaker_id", "s.text").join(written.select("segment_id"), "segment_id", "left_anti")
    line = F.concat(F.lit("- [speaker "), "speaker_id", F.lit("] "), "text", F.lit("\n<!-- conv_id: "), "id", F.lit(" -->\n<!-- segment_id: "), "segment_id", F.lit(" -->\n"))
    talks = rows.groupBy("day", "id", "started_at", "finished_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    part = F.concat(F.lit("\n## Conversation "), "id", F.lit(" ("), F.date_format("started_at", "HH:mm:ss"), F.lit("–"), F.date_format("finished_at", "HH:mm:ss"), F.lit(")\n\n"), "body")
    return talks.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_at", "id", part.alias("part")))), lambda x: x["part"]), "\n").alias("text"), F.sum("n").alias("segments"))


def frontmatter(text: Column) -> Column:
    """The lines between the two lines of dashes at the top, each with its newline; null without them."""
    found = F.regexp_extract(text, r"(?s)\A---\r?\n((?:(?!---\r?\n).*?\n)?)---\r?(?:\n|\z)", 1)
    return F.when(text.rlike(r"(?s)\A---\r?\n(?:(?!---\r?\n).*?\n)?---\r?(?:\n|\z)"), found)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n(?:(?!---\r?\n).*?\n)?---\r?(?:\n|\z)", "")


def scalar_fields(head: Column) -> Column:
    """map of the one-line fields of a frontmatter, quotes dropped; the last of a repeated key counts."""
    lines = F.filter(F.split(F.coalesce(head, F.lit("")), "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_]+:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[A-Za-z0-9_]+:(.*)$", 1)), "^([\"'])(.*)\\1$", "$2").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def yaml_string(value: Column) -> Column:
    flat = F.translate(value, "\n\r", "  ")
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def update_frontmatter(text: Column, updates: dict[str, Column]) -> Column:
    """The note with the given fields anew, at the end of the frontmatter in the given order; other lines stay as they are."""
    keys = "|".join(updates)
    kept = F.regexp_replace(F.coalesce(frontmatter(text), F.lit("")), rf"(?m)^(?:{keys}):.*\n(?:(?![A-Za-z0-9_]+:).*\n)*", "")
    new = F.concat(*[F.concat(F.lit(f"{k}: "), yaml_string(v), F.lit("\n")) for k, v in updates.items()])
    return F.concat(F.lit("---\n"), kept, new, F.lit("---\n"), body(text))


def transcript_text(note_body: Column) -> Column:
    """What follows the transcript heading, or all of it."""
    found = F.regexp_extract(note_body, r"(?sm)^## Transcript[ \t]*\n(.*)\z", 1)
    return F.trim(F.when(found == "", note_body).otherwise(found))


def _literals(texts: pd.Series) -> pd.Series:
    def one(value: str | None) -> str | None:
        if not value or not value.lstrip().startswith("{"):
            return None
        try:
            found = ast.literal_eval(value.strip())
            return json.dumps(found) if isinstance(found, dict) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return pd.Series([one(v) for v in texts], dtype=object)


def literal_json(text: Column) -> Column:
    """A text that is a dictionary in Python's notation (single quotes, True, None, tuples), as JSON; null for others."""
    return F.pandas_udf(_literals, "string")(text)


def tolerant_json(text: Column) -> Column:
    """A JSON object as a variant from what a model answers: fenced, wrapped in words, short of braces, with curly quotes or trailing commas, as a JSON string of itself, or in Python's notation; else null.

    Python reads only the texts that all else fails on.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\s﻿]+|\\s+$", "")
    unfenced = F.regexp_replace(bare, r"(?s)\A```[^\n]*\n(.*)\n```\z", "$1")
    inner = F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)

    def fixes(x: Column) -> list[Column]:
        missing = F.greatest(F.length(F.replace(x, F.lit("}"), F.lit(""))) - F.length(F.replace(x, F.lit("{"), F.lit(""))), F.lit(0))
        plain = F.regexp_replace(F.translate(x, "“”‘’", "\"\"''"), r",\s*([}\]])", "$1")
        return [x, F.when(F.ltrim(x).startswith("{"), F.concat(x, F.repeat(F.lit("}"), missing))), plain]

    candidates = (bare, unfenced, F.nullif(inner, F.lit("")))
    tries = [F.try_parse_json(c) for x in candidates for c in fixes(x)]
    tries += [F.try_parse_json(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))) for v in map(F.try_parse_json, (bare, unfenced))]
    objects = [F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in tries]
    rest = [F.try_parse_json(literal_json(F.when(F.coalesce(*objects).isNull() & F.contains(x, F.lit("{")), x))) for x in candidates]
    return F.coalesce(*objects, *[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in rest])


def clean_sentence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "—–", "--"), r"\s+", " "))


def metadata_payload(df: DataFrame, value: str) -> DataFrame:
    """df with signpost, summary, themes (7 at most), open_questions (5 at most) of a variant column; all null unless all four are there and sound."""
    get = lambda k, t: F.expr(f"try_variant_get({value}, '$.{k}', '{t}')")
    lists = {k: F.slice(F.filter(F.transform(get(k, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), 1, n) for k, n in (("themes", 7), ("open_questions", 5))}
    sentences = {k: clean_sentence(get(k, "string")) for k in ("signpost", "summary")}
    sound = (sentences["signpost"] != "") & (sentences["summary"] != "") & get("themes", "array<string>").isNotNull() & get("open_questions", "array<string>").isNotNull()
    return df.withColumns({k: F.when(sound, v) for k, v in (sentences | lists).items()})


def metadata_status(enabled: bool, fields: Column, version: int, transcript: Column) -> Column:
    """Why a note's metadata is left alone (disabled, up_to_date, empty_transcript), or generate."""
    expected = F.sha2(F.concat(fields["content_hash"], F.lit(f"|v{version}")), 256)
    current = (fields["meta_version"] == str(version)) & (fields["meta_hash"] == expected)
    return F.when(~F.lit(enabled), "disabled").when(F.coalesce(current, F.lit(False)), "up_to_date").when(transcript == "", "empty_transcript").otherwise("generate")


def scalar_kind(value: Column) -> Column:
    """list, int, float or string: what a plain scalar would be read as."""
    bare = F.trim(value)
    return F.when(bare.rlike(r"^\[.*\]$"), "list").when(bare.rlike(r"^\d+$"), "int").when(bare.rlike(r"^-?\d+\.\d+$"), "float").otherwise("string")


def metadata_workflow(found: DataFrame, version: int, enabled: bool = True, provider: str | None = "stub", dry_run: bool = False) -> DataFrame:
    """(path, status, text) for notes (path, text) with what a model answered (answer, null where it wasn't asked).

    Statuses: disabled, up_to_date, dry_run, no_provider, empty_transcript: the note stays; json_parse_failed,
    json_validation_failed: it stays too; generated: its frontmatter has signpost, summary, themes and questions anew, with the
    hash that says what they were made of. Where there is no answer yet, waiting.
    """
    value = F.coalesce("text", F.lit(""))
    rows = found.withColumns({"__fields": scalar_fields(frontmatter(value)), "__transcript": transcript_text(body(value))})
    first = metadata_status(enabled, F.col("__fields"), version, F.col("__transcript"))
    rows = metadata_payload(rows.withColumn("__v", tolerant_json(F.col("answer"))), "__v")
    later = F.when(F.col("answer").isNull(), "waiting").when(F.col("__v").isNull(), "json_parse_failed").when(F.col("signpost").isNull(), "json_validation_failed").otherwise("generated")
    asked = F.when(F.lit(dry_run), "dry_run").when(F.lit(provider is None), "no_provider").when(F.col("__transcript") == "", "empty_transcript").otherwise(later)
    status = F.when(first.isin("disabled", "up_to_date"), first).otherwise(asked)
    made = F.sha2(F.concat(F.coalesce(F.col("__fields")["content_hash"], F.lit("")), F.lit(f"|v{version}")), 256)
    new = {"signpost": F.col("signpost"), "summary": F.col("summary"), "themes": F.array_join("themes", ", "), "open_questions": F.array_join("open_questions", " / "), "meta_provider": F.lit(provider or ""), "meta_version": F.lit(str(version)), "meta_hash": made}
    text = F.when(status == "generated", update_frontmatter(F.col("text"), new)).otherwise(F.col("text"))
    return rows.select("path", status.alias("status"), text.alias("text"))
