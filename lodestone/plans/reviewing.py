"""Registered queries: review, applied and undone writes, routed outputs, model answers, daily lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import classify, conversations, distill, review
from ..operators.notes import BEGIN, CLOSE, mark
from .capturing import _ACTIONS, _ENTITIES, _NOTES, _SUMMARY, _TASKS, _notes, _said, _said_sql, _sql_counts

DAY, TIME = "2024-01-02", "10:00"


def _proposals(spark, d):
    """The proposals of all captures' distilled artifacts."""
    text = F.col("text")
    made = _notes(spark, d).select("capture_id", distill.summary(text).alias("summary"), distill.confidence(text).alias("confidence"), distill.tasks(text).alias("tasks"), distill.entity_array(text).alias("entities"), F.concat(F.lit("distill/"), "capture_id", F.lit(".json")).alias("file"))
    return review.from_artifacts(made, DAY)


_PROPOSALS = f"""{_NOTES}, {_TASKS}, {_SUMMARY}, {_ENTITIES}, nt AS (SELECT capture_id, count(*) AS n FROM t GROUP BY 1),
    parts AS (SELECT capture_id, 0::BIGINT AS ord, 'note' AS artifact_type, 'Distill: ' || capture_id[:8] AS title, summary AS content, '20_memory/daily/{DAY}.md' AS destination, round(confidence, 4) AS confidence FROM sm
        UNION ALL SELECT t.capture_id, pos + 1, 'task', NULL, t.text, '30_tasks/todo.md', round(confidence * 0.9::DOUBLE, 4) FROM t JOIN sm ON sm.capture_id = t.capture_id
        UNION ALL SELECT ent.capture_id, coalesce(n, 0) + ord, 'entity', name, '{{"name":' || to_json(name)::VARCHAR || ',"kind":"' || kind || '"}}', '20_memory/entities.json', round(confidence * 0.8::DOUBLE, 4) FROM ent JOIN sm ON sm.capture_id = ent.capture_id LEFT JOIN nt ON nt.capture_id = ent.capture_id),
    proposals AS (SELECT *, sha256(capture_id || '|distill/' || capture_id || '.json|' || ord || '|' || artifact_type || '|' || content) AS proposal_id FROM parts)"""


def review_proposals(spark, d):
    return _proposals(spark, d).select("proposal_id", "capture_id", F.col("ord").cast("long").alias("ord"), "artifact_type", F.coalesce("title", F.lit("-")).alias("title"), "destination", "confidence")


def review_dispatch(spark, d):
    """What the approval of every proposal writes, and where."""
    return review.dispatch(_proposals(spark, d), DAY).select("proposal_id", "path", "mode", F.md5("text").alias("md5"))


def review_corrections(spark, d):
    """Every second artifact type of each capture corrected twice; what the last correction writes."""
    rows = _proposals(spark, d)
    kinds = F.array(*map(F.lit, ("memory", "principle", "decision", "task")))
    fixes = [rows.select("proposal_id", F.lit(seq).alias("seq"), F.element_at(kinds, ((F.col("ord") + seq) % 4 + 1).cast("int")).alias("artifact_type"), F.lit(title).alias("title"), F.concat(F.lit(f"fix {seq} "), "capture_id").alias("content"), F.lit("").alias("destination")) for seq, title in ((1, "first"), (2, "second"))]
    fixed = review.corrected(rows, fixes[0].unionByName(fixes[1]).filter("seq = 1 or artifact_type != 'task'"))
    return fixed.select("corrects", "original_type", "artifact_type", "title", "content", "destination", "confidence")


def review_bootstrap(spark, d):
    """The queue of all proposals with pending ones in it, and without any."""
    rows = _proposals(spark, d).select("proposal_id", F.col("ord").alias("seq"), "artifact_type")
    queue = rows.withColumn("status", F.when(F.col("artifact_type") == "task", "pending").otherwise("approved"))
    one = review.bootstrap(queue, rows.filter("artifact_type = 'note'")).withColumn("part", F.lit("waiting"))
    two = review.bootstrap(queue.filter("status != 'pending'"), rows.filter("artifact_type = 'note'")).withColumn("part", F.lit("generated"))
    return one.unionByName(two).select("part", "proposal_id", "status")


def review_events(spark, d):
    """Learning events of actions on all proposals, every third of which is a step that does nothing."""
    rows = _proposals(spark, d)
    names = F.array(*map(F.lit, ("approve", "veto", "quit")))
    actions = rows.select(F.col("proposal_id").alias("item_id"), F.col("ord").alias("seq"), F.element_at(names, (F.col("ord") % 3 + 1).cast("int")).alias("action"))
    return review.events(rows, actions).groupBy("event_type", F.col("payload")["artifact_type"].alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))


def distill_writes(spark, d):
    """What distilling all captures appends to the daily note, to a todo file that holds the benchmark's texts, and to a store that knows some entities."""
    items = _notes(spark, d).withColumn("write_id", F.md5("capture_id"))
    todo = model.table(spark, d, "benchmark").select(F.lit("todo.md").alias("path"), _said(F.col("text")).alias("text"))
    known = distill.entities(_notes(spark, d)).filter(F.length("name") % 2 == 0)
    return distill.writes(items, todo, known, DAY, TIME, "daily.md").select("capture_id", "path", "content_hash")


_LEVEL = "CASE priority WHEN 'high' THEN '[HIGH]' WHEN 'low' THEN '[LOW]' ELSE '[MED]' END"
_NL = "chr(10)"
_WRITES = rf"""{_NOTES}, {_TASKS}, {_SUMMARY}, {_ENTITIES},
    pl AS (SELECT capture_id, unnest(list_filter(list_transform(string_split(text, {_NL}), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '')[:5]) AS line, generate_subscripts(list_filter(list_transform(string_split(text, {_NL}), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '')[:5], 1) AS k FROM captures),
    pts AS (SELECT capture_id, string_agg('- ' || line[:100], {_NL} ORDER BY k) AS items FROM pl WHERE length(line) > 10 GROUP BY 1),
    ppl AS (SELECT capture_id, string_agg('- ' || name || ' [' || kind || ']', {_NL} ORDER BY ord) AS items FROM ent GROUP BY 1),
    tls AS (SELECT capture_id, string_agg('- [ ] ' || {_LEVEL} || ' ' || text, {_NL} ORDER BY pos) AS items FROM t GROUP BY 1),
    daily AS (SELECT sm.capture_id, 'daily.md' AS path, concat_ws({_NL}, '<!-- block:' || md5(sm.capture_id) || ' begin -->', '### Distilled ({TIME} UTC) — ' || sm.capture_id[:8], '', '**Summary:** ' || summary, '',
        '**Key Points:**' || {_NL} || pts.items || {_NL}, '**Entities:**' || {_NL} || ppl.items || {_NL}, '**Tasks:**' || {_NL} || tls.items || {_NL}, '<!-- block:' || md5(sm.capture_id) || ' end -->', '') AS x
        FROM sm LEFT JOIN pts ON pts.capture_id = sm.capture_id LEFT JOIN ppl ON ppl.capture_id = sm.capture_id LEFT JOIN tls ON tls.capture_id = sm.capture_id),
    todo AS MATERIALIZED (SELECT DISTINCT {_said_sql("text")} AS todo FROM benchmark WHERE text IS NOT NULL),
    once AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY capture_id, pos) = 1),
    fresh AS (SELECT capture_id, string_agg('- [ ] ' || {_LEVEL} || ' ' || text, {_NL} ORDER BY pos) AS items FROM once WHERE NOT EXISTS (SELECT 1 FROM todo WHERE contains(todo, once.text)) GROUP BY 1),
    tasked AS (SELECT capture_id, 'todo.md' AS path, concat_ws({_NL}, '<!-- block:' || md5(capture_id) || ' begin -->', '## Draft tasks ({DAY})', '', items, '', '<!-- block:' || md5(capture_id) || ' end -->', '') AS x FROM fresh),
    known AS (SELECT DISTINCT lower(name) AS low, kind FROM ent WHERE length(name) % 2 = 0),
    news AS (SELECT * FROM ent WHERE (lower(name), kind) NOT IN (SELECT (low, kind) FROM known) QUALIFY row_number() OVER (PARTITION BY lower(name), kind ORDER BY capture_id, ord) = 1),
    stored AS (SELECT capture_id, 'entities.json' AS path, '[' || string_agg('{{"name":' || to_json(name)::VARCHAR || ',"kind":"' || kind || '","first_seen_at":"{DAY}T{TIME}:00Z","last_seen_at":"{DAY}T{TIME}:00Z","source_capture_ids":["' || capture_id || '"],"write_id":"' || md5(capture_id) || '"}}', ',' ORDER BY ord) || ']' AS x FROM news GROUP BY capture_id)
    SELECT capture_id, path, sha256(x) AS content_hash FROM (SELECT * FROM daily UNION ALL SELECT * FROM tasked UNION ALL SELECT * FROM stored)"""


def distill_undo(spark, d):
    """A block in each document taken back again: some were edited, some have no block, some stand in an entity store."""
    f = model.files(spark, d).select("file_id", "text")
    ident, k = F.md5(F.col("file_id").cast("string")), F.col("file_id") % 5
    block = F.concat(mark(ident, BEGIN), F.lit("\n- one\n"), mark(ident, CLOSE), F.lit("\n"))
    path = F.concat(F.col("file_id").cast("string"), F.when(k == 4, "/entities.json").otherwise(".md"))
    files = f.select(path.alias("path"), F.when(k == 3, F.col("text")).otherwise(F.concat("text", F.lit("\n"), F.when(k == 2, F.replace(block, F.lit("one"), F.lit("two"))).otherwise(block), F.lit("behind"))).alias("text"))
    records = f.select(ident.alias("write_id"), path.alias("path"), F.when(k != 1, F.sha2(block, 256)).alias("content_hash"))
    after, told = distill.undo(files, records)
    return after.join(told, "path").select("path", "status", F.md5("text").alias("md5"))


def route_outputs(spark, d):
    rows = classify.route_by_rules(_notes(spark, d)).withColumns({"raw_path": F.concat(F.lit("in/"), "capture_id", F.lit(".txt")), "meta_path": F.concat(F.lit("in/"), "capture_id", F.lit(".txt.meta.json"))})
    return classify.routed_outputs(rows, DAY, "T").select("capture_id", "path", F.get_json_object("text", "$.route_label").alias("label"), F.coalesce(F.get_json_object("text", "$.review_reason"), F.lit("-")).alias("reason"), F.size(F.from_json(F.get_json_object("text", "$.next_actions"), "array<string>")).cast("long").alias("actions"))


def model_routes(spark, d):
    """Answers about each document, sound, fenced, out of range, of unknown label, or broken, as routing results."""
    n = F.col("file_id").cast("string")
    good = F.concat(F.lit('{"route_label": "idea", "confidence": 0.8149, "next_actions": ["a'), n, F.lit('", "b", "c", "d"], "reasoning": "r"}'))
    k = F.col("file_id") % 6
    text = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.lit('{"route_label": "TASK", "confidence": 7}')).when(k == 3, F.lit('{"route_label": "odd", "confidence": -1, "next_actions": "x"}')).when(k == 4, F.lit("{}")).otherwise(F.lit("no json"))
    rows = classify.coerce_route(model.files(spark, d).select("file_id", text.alias("answer")))
    return rows.select("file_id", "label", "confidence", F.array_join("next_actions", "|").alias("actions"), "reasoning")


def daily_conversation_lines(spark, d):
    rows = conversations.conversation_rows(model.messages(spark, d)).withColumn("conversation_id", F.col("conv_id").cast("string"))
    items = rows.select("conversation_id", F.date_format(F.timestamp_seconds(F.lit(model.EPOCH) + F.col("conv_id") * 7200), "yyyy-MM-dd").alias("day"), F.col("conv_id").alias("created_at"), F.concat(F.lit("c"), "conversation_id").alias("title"))
    paths = rows.filter("conv_id % 2 = 0").select("conversation_id", F.concat(F.lit("chats/"), "conversation_id", F.lit(".md")).alias("path"))
    told = rows.filter("conv_id % 3 = 0").select("conversation_id", F.lit("about\nit ").alias("signpost"), (F.col("conv_id") % 2 == 0).alias("partial"), F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("why?"), F.lit("how?"))).alias("open_questions"))
    return conversations.daily_lines(items, paths, told).select("day", F.md5("block").alias("md5"))


_DAILY = f"""WITH m AS (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) != ''),
    l AS (SELECT conv_id, strftime(make_timestamp(({model.EPOCH} + conv_id * 7200) * 1000000), '%Y-%m-%d') AS day, '- [[' || (CASE WHEN conv_id % 2 = 0 THEN 'chats/' ELSE 'c' END) || conv_id || ']]'
        || (CASE WHEN conv_id % 3 = 0 THEN chr(10) || '  - about it' || (CASE WHEN conv_id % 2 = 0 THEN ' ⏳' ELSE '' END) ELSE '' END) || (CASE WHEN conv_id % 15 = 0 THEN chr(10) || '  - Q: why?' ELSE '' END) AS line FROM m)
    SELECT day, md5(string_agg(line, chr(10) ORDER BY conv_id)) AS md5 FROM l GROUP BY day"""
_BLOCK = "'<!-- block:' || i || ' begin -->' || chr(10) || '- one' || chr(10) || '<!-- block:' || i || ' end -->' || chr(10)"
QUERIES = {
    "review_proposals": (review_proposals, f"{_PROPOSALS} SELECT proposal_id, capture_id, ord, artifact_type, coalesce(title, '-') AS title, destination, confidence FROM proposals"),
    "review_dispatch": (review_dispatch, f"""{_PROPOSALS} SELECT proposal_id, destination AS path, CASE artifact_type WHEN 'note' THEN 'create' ELSE 'append' END AS mode,
        md5(CASE artifact_type WHEN 'note' THEN '# ' || title || chr(10) || chr(10) || content WHEN 'task' THEN '- [ ] ' || content || chr(10)
            ELSE content[:length(content) - 1] || ', "first_seen_at": "{DAY}", "last_seen_at": "{DAY}", "proposal_id": "' || proposal_id || '"}}' END) AS md5 FROM proposals"""),
    "review_corrections": (review_corrections, f"""{_PROPOSALS}, turned AS (SELECT *, ['memory', 'principle', 'decision', 'task'][(ord + 2) % 4 + 1] AS second FROM proposals)
        SELECT proposal_id AS corrects, artifact_type AS original_type, CASE WHEN second != 'task' THEN second ELSE ['memory', 'principle', 'decision', 'task'][(ord + 1) % 4 + 1] END AS artifact_type,
            CASE WHEN second != 'task' THEN 'second' ELSE 'first' END AS title, (CASE WHEN second != 'task' THEN 'fix 2 ' ELSE 'fix 1 ' END) || capture_id AS content, destination, 1.0::DOUBLE AS confidence FROM turned"""),
    "review_bootstrap": (review_bootstrap, f"{_PROPOSALS} SELECT CASE artifact_type WHEN 'task' THEN 'waiting' ELSE 'generated' END AS part, proposal_id, 'pending' AS status FROM proposals WHERE artifact_type IN ('task', 'note')"),
    "review_events": (review_events, f"{_PROPOSALS} SELECT CASE ord % 3 WHEN 0 THEN 'REVIEW_APPROVED' ELSE 'REVIEW_VETOED' END AS event_type, artifact_type, count(*) AS n FROM proposals WHERE ord % 3 < 2 GROUP BY ALL"),
    "distill_writes": (distill_writes, _WRITES),
    "distill_undo": (distill_undo, f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, md5(doc_id::VARCHAR) AS i, doc_id % 5 AS k FROM documents)
        SELECT doc_id || (CASE WHEN k = 4 THEN '/entities.json' ELSE '.md' END) AS path, CASE k WHEN 2 THEN 'modified' WHEN 3 THEN 'missing_block' WHEN 4 THEN 'skipped' ELSE 'undone' END AS status,
            md5(text || (CASE k WHEN 3 THEN '' WHEN 2 THEN chr(10) || replace({_BLOCK}, 'one', 'two') || 'behind' WHEN 4 THEN chr(10) || {_BLOCK} || 'behind' ELSE 'behind' END)) AS md5 FROM f"""),
    "route_outputs": (route_outputs, f"""{_NOTES}, {_sql_counts()}, {_ACTIONS} SELECT capture_id, (CASE WHEN confidence < 0.7 THEN '10_derived/review_queue/{DAY}/' ELSE '10_derived/routed/{DAY}/' END) || capture_id || '.json' AS path, label,
        CASE WHEN confidence < 0.7 THEN printf('Confidence %.2f below threshold 0.70', confidence) ELSE '-' END AS reason, CASE WHEN label = 'UNKNOWN' THEN 0 ELSE (SELECT count(*) FROM e WHERE e.capture_id = rules.capture_id) END AS actions FROM rules"""),
    "model_routes": (model_routes, """SELECT doc_id AS file_id, CASE doc_id % 6 WHEN 0 THEN 'IDEA' WHEN 1 THEN 'IDEA' WHEN 2 THEN 'TASK' ELSE 'UNKNOWN' END AS label, (CASE doc_id % 6 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5 WHEN 5 THEN 0.3 ELSE 0.81 END)::DOUBLE AS confidence,
        CASE WHEN doc_id % 6 < 2 THEN 'a' || doc_id || '|b|c' ELSE '' END AS actions, CASE doc_id % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'r' WHEN 5 THEN 'JSON parse error from LLM response' ELSE '' END AS reasoning FROM documents"""),
    "daily_conversation_lines": (daily_conversation_lines, _DAILY),
}
