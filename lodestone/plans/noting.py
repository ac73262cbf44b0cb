"""Registered queries: note texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions.text import let
from ..operators import distill, notes
from .capturing import _NOTES, _SUMMARY, _TASKS
from .capturing import _notes as _captures


def daily_note_blocks(spark, d):
    rows = _captures(spark, d)
    text = F.col("text")
    none = F.array().cast("array<struct<name:string,kind:string>>")
    block = notes.daily_block(F.col("capture_id"), F.lit("10:00"), F.col("capture_id"), distill.summary(text), F.array().cast("array<string>"), none, distill.tasks(text))
    return rows.select("capture_id", F.md5(notes.appended(F.when(F.length("capture_id") % 2 == 0, F.lit("# Day\n")), block, "# New\n")).alias("md5"))


def todo_blocks(spark, d):
    rows = _captures(spark, d)
    block = let(distill.tasks(F.col("text")), lambda made: notes.todo_block(F.col("capture_id"), F.lit("2024-01-02"), made, F.get(made, F.lit(0))["text"]))
    return rows.select("capture_id", F.md5(F.coalesce(block, F.lit("none"))).alias("md5"))


def transcript_day_notes(spark, d):
    m = model.messages(spark, d).withColumn("segment_id", F.concat_ws("-", "conv_id", "turn"))
    segment = F.struct("turn", "segment_id", F.col("role").alias("speaker_id"), F.col("content").alias("text"), F.lit(None).cast("timestamp").alias("created_at"))
    start = F.timestamp_seconds(F.lit(model.EPOCH) + F.col("conv_id") * 7200)
    talks = m.groupBy(F.col("conv_id").cast("string").alias("id"), start.alias("started_at")).agg(F.array_sort(F.collect_list(segment)).alias("segments"), F.count(F.lit(1)).alias("n"))
    talks = talks.withColumn("finished_at", F.timestamp_seconds(F.unix_seconds("started_at") + F.col("n")))
    written = m.filter("turn = 1").select("segment_id")
    return notes.transcript_notes(talks, written).select("day", "segments", F.md5("text").alias("md5"))


def frontmatter_updates(spark, d):
    rows = model.files(spark, d).select("file_id", F.concat(F.lit("---\ntitle: \"a\"\nsummary: old\n  more\nlang: "), "lang", F.lit("\n---\n"), "text").alias("note"))
    new = notes.update_frontmatter(F.col("note"), {"summary": F.col("file_id").cast("string")})
    fields = notes.scalar_fields(notes.frontmatter(new))
    return rows.select("file_id", F.md5(new).alias("md5"), fields["lang"].alias("lang"), fields["summary"].alias("summary"))


def tolerant_answers(spark, d):
    """A JSON answer about each document in one of five broken shapes, read anyway."""
    n = F.col("file_id").cast("string")
    good = F.concat(F.lit('{"signpost": "s'), n, F.lit('", "summary": "a  b", "themes": ["x", " "], "open_questions": []}'))
    k = F.col("file_id") % 5
    text = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), good, F.lit(" done"))).when(k == 3, F.replace(good, F.lit("[]}"), F.lit("[],}"))).otherwise(F.lit("no json"))
    rows = model.files(spark, d).select("file_id", notes.tolerant_json(text).alias("v"))
    return notes.metadata_payload(rows, "v").select("file_id", F.coalesce("signpost", F.lit("none")).alias("signpost"), F.coalesce("summary", F.lit("none")).alias("summary"), F.coalesce(F.array_join("themes", ","), F.lit("none")).alias("themes"))


_MARK = "CASE priority WHEN 'high' THEN '[HIGH]' WHEN 'low' THEN '[LOW]' ELSE '[MED]' END"
QUERIES = {
    "daily_note_blocks": (daily_note_blocks, f"""{_NOTES}, {_TASKS}, {_SUMMARY}, tl AS (SELECT capture_id, string_agg('- [ ] ' || {_MARK} || ' ' || text, chr(10) ORDER BY pos) AS items FROM t GROUP BY 1),
        blk AS (SELECT sm.capture_id, '<!-- block:' || sm.capture_id || ' begin -->' || chr(10) || '### Distilled (10:00 UTC) — ' || sm.capture_id[:8] || chr(10) || chr(10) || '**Summary:** ' || summary || chr(10) || chr(10)
            || coalesce('**Tasks:**' || chr(10) || items || chr(10) || chr(10), '') || '<!-- block:' || sm.capture_id || ' end -->' || chr(10) AS block FROM sm LEFT JOIN tl ON tl.capture_id = sm.capture_id)
        SELECT capture_id, md5(CASE WHEN length(capture_id) % 2 = 0 THEN '# Day' || chr(10) || chr(10) || block ELSE '# New' || chr(10) || block END) AS md5 FROM blk"""),
    "todo_blocks": (todo_blocks, f"""{_NOTES}, {_TASKS}, fst AS (SELECT capture_id, text AS first FROM t WHERE pos = 0),
        k AS (SELECT t.capture_id, string_agg('- [ ] ' || {_MARK} || ' ' || t.text, chr(10) ORDER BY pos) AS items FROM t JOIN fst ON fst.capture_id = t.capture_id WHERE NOT contains(first, t.text) GROUP BY 1)
        SELECT c.capture_id, md5(coalesce('<!-- block:' || c.capture_id || ' begin -->' || chr(10) || '## Draft tasks (2024-01-02)' || chr(10) || chr(10) || items || chr(10) || chr(10) || '<!-- block:' || c.capture_id || ' end -->' || chr(10), 'none')) AS md5 FROM captures c LEFT JOIN k ON k.capture_id = c.capture_id"""),
    "transcript_day_notes": (transcript_day_notes, f"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS content, make_timestamp(({model.EPOCH} + conv_id * 7200) * 1000000) AS s, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        g AS (SELECT conv_id, s, any_value(n) AS n, count(*) AS k, string_agg('- [speaker ' || role || '] ' || content || chr(10) || '<!-- conv_id: ' || conv_id || ' -->' || chr(10) || '<!-- segment_id: ' || conv_id || '-' || turn || ' -->' || chr(10), chr(10) ORDER BY turn) AS body FROM m WHERE turn != 1 GROUP BY conv_id, s),
        p AS (SELECT *, chr(10) || '## Conversation ' || conv_id || ' (' || strftime(s, '%H:%M:%S') || '–' || strftime(s + to_seconds(n), '%H:%M:%S') || ')' || chr(10) || chr(10) || body AS part FROM g)
        SELECT strftime(s, '%Y-%m-%d') AS day, sum(k)::BIGINT AS segments, md5(string_agg(part, chr(10) ORDER BY s, conv_id::VARCHAR)) AS md5 FROM p GROUP BY 1"""),
    "frontmatter_updates": (frontmatter_updates, """SELECT doc_id AS file_id, md5('---' || chr(10) || 'title: "a"' || chr(10) || 'lang: ' || lang || chr(10) || 'summary: "' || doc_id || '"' || chr(10) || '---' || chr(10) || coalesce(text, '')) AS md5, lang, doc_id::VARCHAR AS summary FROM documents"""),
    "tolerant_answers": (tolerant_answers, "SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 4 THEN 'none' ELSE 's' || doc_id END AS signpost, CASE WHEN doc_id % 5 = 4 THEN 'none' ELSE 'a b' END AS summary, CASE WHEN doc_id % 5 = 4 THEN 'none' ELSE 'x' END AS themes FROM documents"),
}
