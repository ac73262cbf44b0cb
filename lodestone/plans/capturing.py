"""Registered queries: routing, intents, extraction, distilling, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.text import actions, content_type, safe_title
from ..operators import classify, conversations, distill, ledger

_C = model.with_sql("captures")


def _sql_counts() -> str:
    cols = []
    for label, words in classify.KEYWORDS.items():
        cols.append("(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f") AS n_{label}")
    labels = list(classify.KEYWORDS)
    best = "greatest(" + ", ".join(f"n_{k}" for k in labels) + ")"
    top = "CASE " + " ".join(f"WHEN n_{k} = best THEN '{k}'" for k in labels) + " END"
    rivals = " + ".join(f"(n_{k} > 0 AND n_{k} >= best * 0.7)::INT" for k in labels)
    strip = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
    return f"""kc AS (SELECT *, {", ".join(cols)} FROM captures), kb AS (SELECT *, {best} AS best, {strip} < 5 AS short FROM kc),
        kt AS (SELECT *, {top} AS top, NOT short AND best > 0 AND ({rivals}) > 1 AS ambiguous FROM kb),
        rules AS (SELECT capture_id, text, best, short, CASE WHEN short OR best = 0 THEN 'UNKNOWN' ELSE top END AS label, ambiguous,
            (CASE WHEN short THEN 0.1 WHEN best = 0 THEN 0.3 WHEN best = 1 THEN CASE WHEN ambiguous THEN 0.5 ELSE 0.6 END
                WHEN best = 2 THEN CASE WHEN ambiguous THEN 0.65 ELSE 0.75 END ELSE CASE WHEN ambiguous THEN 0.75 ELSE 0.9 END END)::DOUBLE AS confidence FROM kt),
        hb AS (SELECT *, 0.6::DOUBLE + ('0x' || md5(text)[:4])::BIGINT / 65535.0::DOUBLE * 0.35::DOUBLE AS base FROM rules),
        hashed AS (SELECT *, CASE WHEN short THEN 0.2 WHEN best = 0 THEN round(base * 0.5::DOUBLE, 2) WHEN best >= 3 THEN round(least(0.95::DOUBLE, base + 0.15::DOUBLE), 2) WHEN best = 2 THEN round(base + 0.05::DOUBLE, 2) ELSE round(base, 2) END::DOUBLE AS model_confidence FROM hb)"""


_KC = f"{_C}, {_sql_counts()}"


def route_rule(spark, d):
    return classify.route_by_rules(model.captures(spark, d)).select("capture_id", "label", "confidence", "ambiguous")


def route_rule_gate_counts(spark, d):
    rows = classify.gate(classify.route_by_rules(model.captures(spark, d)))
    return rows.groupBy("label", "routed").agg(F.count(F.lit(1)).alias("n"))


def route_model_confidence(spark, d):
    return classify.route_by_hash(model.captures(spark, d)).select("capture_id", "label", "confidence")


def route_hybrid_choice(spark, d):
    return classify.route_hybrid(model.captures(spark, d), threshold=0.75).select("capture_id", "label", "confidence", "engine")


def intent_cascade(spark, d):
    return classify.intent(model.captures(spark, d)).select("capture_id", "intent", "confidence", "agent")


def _intent_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{i}'" for p, i in classify.INTENTS)
    agents = " ".join(f"WHEN '{i}' THEN '{a}'" for i, a in classify.AGENTS.items())
    return rf"""{_C}, h AS (SELECT capture_id, CASE {cases} WHEN lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) IN ('ok', 'lol', 'nice', 'thanks') THEN 'ignore' END AS hard FROM captures)
        SELECT capture_id, coalesce(hard, 'reflect') AS intent, (CASE WHEN hard IS NULL THEN 0.5 ELSE 0.99 END)::DOUBLE AS confidence, CASE coalesce(hard, 'reflect') {agents} END AS agent FROM h"""


#: Words of the corpus that stand in for what people write, in all its languages: the corpus itself has none of the trigger words.
WORDS = ((" of ", " need to "), (" de ", " need to "), (" und ", " need to "), (" that ", " should "), (" la ", " should "), (" die ", " should "), (" by ", " urgent "), (" en ", " urgent "))


def _said(text):
    """The text with some of its own words turned into triggers, so that extraction has something to find."""
    for word, trigger in WORDS:
        text = F.replace(text, F.lit(word), F.lit(trigger))
    return text


def _said_sql(column: str) -> str:
    for word, trigger in WORDS:
        column = f"replace({column}, '{word}', '{trigger}')"
    return column


def _notes(spark, d):
    """All captures, in these words."""
    return model.captures(spark, d).select("capture_id", _said(F.col("text")).alias("text"))


_NOTES = f"{_C.replace('captures AS', 'raw_captures AS', 1)}, captures AS (SELECT capture_id, {_said_sql('text')} AS text FROM raw_captures)"


def route_notes(spark, d):
    return classify.route_by_rules(_notes(spark, d)).select("capture_id", "label", "confidence", "ambiguous", F.array_join("next_actions", "|").alias("next_actions"))


def extract_actions(spark, d):
    return _notes(spark, d).select("capture_id", F.posexplode(actions(F.col("text"))).alias("pos", "action"))


_ACTIONS = r"""a AS (SELECT capture_id, list_concat(list_concat(regexp_extract_all(text, '(?i)need to (.+?)(?:\.|$|\n)', 1), regexp_extract_all(text, '(?i)must (.+?)(?:\.|$|\n)', 1)),
        list_concat(regexp_extract_all(text, '(?i)should (.+?)(?:\.|$|\n)', 1), list_concat(regexp_extract_all(text, '(?i)todo:?\s*(.+?)(?:\.|$|\n)', 1), regexp_extract_all(text, '(?i)action:?\s*(.+?)(?:\.|$|\n)', 1)))) AS found FROM captures),
    b AS (SELECT capture_id, unnest(found) AS raw, generate_subscripts(found, 1) AS i FROM a),
    c AS (SELECT capture_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS action, min(i) AS i FROM b GROUP BY ALL HAVING action != ''),
    e AS (SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY i) - 1)::INT AS pos, action FROM c QUALIFY pos < 3)"""


def conversation_destination(spark, d):
    rows = conversations.conversation_rows(model.messages(spark, d))
    return classify.destination(rows)


def _destination_sql() -> str:
    words = " OR ".join(f"contains(low, '{w}')" for w in classify.TOOL_WORDS)
    traces = " OR ".join(f"regexp_matches(low, '{t}')" for t in classify.TRACES)
    starts = "|".join(classify.TITLE_STARTS)
    return rf"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) != ''),
        g AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY turn, content) AS text, arg_min(content, turn)[:40] AS title, count(*) AS n, avg(length(trim(content))) AS mean FROM m GROUP BY conv_id),
        w AS (SELECT *, title || chr(10) || text AS whole, lower(title || chr(10) || text) AS low, string_split(title || chr(10) || text, '```') AS parts FROM g),
        s AS (SELECT conv_id, (len(parts) // 2)::BIGINT AS fences,
            round(coalesce(list_sum(list_transform(range(2, len(parts) + 1, 2), lambda i: length(parts[i]))), 0) / length(whole)::DOUBLE, 6)::DOUBLE AS code_share,
            ({words}) AS tool_word, ({traces}) AS trace, regexp_matches(lower(trim(title)), '^({starts})') AS title_start, n >= 6 AND mean <= 120 AS short_iterative FROM w)
        SELECT *, CASE WHEN fences >= 2 OR code_share >= 0.25 OR trace OR (tool_word AND (title_start OR short_iterative)) THEN 'tooling' ELSE 'daemon' END AS destination FROM s"""


def conversation_sticky_route(spark, d):
    rows = conversations.conversation_rows(model.messages(spark, d))
    stored = rows.filter("conv_id % 3 = 0").select("conv_id", F.lit("tooling").alias("destination"))
    return classify.sticky(classify.destination(rows).select("conv_id", "destination"), stored).select("conv_id", "destination")


def conversation_content_hash(spark, d):
    return conversations.content_hashes(model.messages(spark, d))


def messages_sorted_filtered(spark, d):
    rows = model.messages(spark, d).filter(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    n = F.row_number().over(conversations.Window.partitionBy("conv_id").orderBy("turn", "role", "content")).cast("long")
    return rows.select("conv_id", n.alias("pos"), "role", F.md5("content").alias("md5"))


def transcript_segment_dedupe(spark, d):
    rows = model.messages(spark, d).select(F.concat(F.col("conv_id").cast("string"), F.lit("_seg_"), (F.col("turn") % 3).cast("string")).alias("segment_id"), "conv_id")
    written = rows.filter("conv_id % 2 = 0").select("segment_id")
    return conversations.new_segments(rows, written).select("segment_id")


def export_normalised(spark, d):
    """The conversations written as export JSON, both as a message list and as a mapping, and read back."""
    m = model.messages(spark, d)
    item = F.struct(F.struct("role").alias("author"), F.struct(F.array("content").alias("parts")).alias("content"), (F.lit(model.EPOCH) + F.col("turn") * 60).alias("create_time"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("message")))).alias("t"))
    listed = F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"), F.lit(model.EPOCH).alias("create_time"), F.transform("t", lambda x: x["message"]).alias("messages")))
    mapped = F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"), F.lit(model.EPOCH).alias("create_time"), F.map_from_arrays(F.transform("t", lambda x: F.concat(F.lit("n"), x["turn"].cast("string"))), F.transform("t", lambda x: F.struct(x["message"].alias("message")))).alias("mapping")))
    exports = g.select(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), listed, F.lit("]"))).otherwise(mapped).alias("value"))
    rows = conversations.normalise(conversations.export_conversations(exports))
    return rows.select("conversation_id", F.size("messages").cast("long").alias("n"), F.unix_seconds("created_at").alias("created"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")).alias("md5"))


def distill_summary(spark, d):
    return model.captures(spark, d).select("capture_id", distill.summary(F.col("text")).alias("summary"), distill.confidence(F.col("text")).alias("confidence"))


def distill_key_points(spark, d):
    return model.captures(spark, d).select("capture_id", F.posexplode(distill.key_points(F.col("text"))).alias("pos", "point"))


def distill_tasks(spark, d):
    return _notes(spark, d).select("capture_id", F.posexplode(distill.tasks(F.col("text"))).alias("pos", "t")).select("capture_id", "pos", "t.text", "t.priority")


_TASKS = r"""l AS (SELECT capture_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM captures),
    s AS (SELECT *, regexp_replace(lower(line), '^\s+|\s+$', '', 'g') AS low FROM l),
    g AS (SELECT * FROM (VALUES (1, 'need to'), (2, 'must'), (3, 'should'), (4, 'todo:'), (5, 'action:')) v(o, trigger)),
    f AS (SELECT capture_id, k, low, o, rtrim(regexp_replace(substring(line, instr(low, trigger) + length(trigger)), '^\s+|\s+$', '', 'g'), '.,;:') AS rest FROM s JOIN g ON contains(low, trigger)),
    r AS (SELECT * FROM f WHERE length(rest) > 3 QUALIFY row_number() OVER (PARTITION BY capture_id, k ORDER BY o) = 1),
    t AS (SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY k) - 1)::INT AS pos, rest[:200] AS text, CASE WHEN contains(low, 'urgent') OR contains(low, 'asap') THEN 'high' WHEN contains(low, 'eventually') OR contains(low, 'someday') THEN 'low' ELSE 'med' END AS priority FROM r QUALIFY pos < 7)"""
_SUMMARY = r"""b AS (SELECT capture_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM captures),
    sm AS (SELECT capture_id, text, CASE WHEN bare = '' THEN 'Empty capture.' WHEN instr(bare, '.') BETWEEN 2 AND 200 THEN bare[:instr(bare, '.')] WHEN instr(bare, '!') BETWEEN 2 AND 200 THEN bare[:instr(bare, '!')] WHEN instr(bare, '?') BETWEEN 2 AND 200 THEN bare[:instr(bare, '?')]
        WHEN length(bare) > 150 THEN bare[:147] || '...' ELSE bare END AS summary, round(0.7::DOUBLE + ('0x' || md5(text)[:4])::BIGINT / 65535.0::DOUBLE * 0.25::DOUBLE, 2) AS confidence FROM b)"""


def distill_entities(spark, d):
    return distill.entities(model.captures(spark, d)).select("capture_id", F.col("ord").cast("long").alias("ord"), "name", "kind")


def proposal_fanout(spark, d):
    return distill.proposals(_notes(spark, d)).select("capture_id", F.col("ord").cast("long").alias("ord"), "artifact_type", "title", "confidence")


def todo_substring_antijoin(spark, d):
    """The tasks of all captures that stand in none of the benchmark's texts."""
    tasks = _notes(spark, d).select("capture_id", F.posexplode(distill.tasks(F.col("text"))).alias("pos", "t")).select("capture_id", "pos", "t.text")
    todo = model.table(spark, d, "benchmark").select(_said(F.col("text")).alias("todo"))
    return distill.new_tasks(tasks, todo)


def entity_dedupe_antijoin(spark, d):
    found = distill.entities(model.captures(spark, d))
    known = found.filter(F.length("name") % 2 == 0)
    return distill.new_entities(found, known, ["capture_id", "ord"]).select("name", "kind", "capture_id")


_ENTITIES = r"""w AS (SELECT capture_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS words FROM captures),
    p AS (SELECT capture_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    n AS (SELECT capture_id, i, trim(word, '.,;:!?"''()[]') AS name, lower(array_to_string(words[greatest(1, i - 2):i - 1], ' ')) AS before FROM p WHERE length(word) >= 3),
    k AS (SELECT capture_id, i, name, CASE WHEN regexp_matches(before, 'met|call|talk|email|@') THEN 'PERSON' WHEN regexp_matches(before, 'project|build|working on') THEN 'PROJECT' WHEN regexp_matches(before, 'using|tool|app|software') THEN 'TOOL' ELSE 'TOPIC' END AS kind
        FROM n WHERE regexp_matches(name, '^\p{Lu}') AND lower(name) NOT IN ('the', 'this', 'that', 'what', 'when', 'where', 'i', 'a', 'an')),
    u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY capture_id, lower(name) ORDER BY i) = 1),
    ent AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY i) AS ord, name, kind FROM u QUALIFY ord <= 7)"""


def salience_lines(spark, d):
    rows = model.lines(spark, d).withColumn("text", F.regexp_replace("text", r"\b[Ww]hat of\b|\b[Bb]y the\b", "next"))
    return distill.salient_lines(rows).select("file_id", "line")


def safe_titles(spark, d):
    rows = model.messages(spark, d).select("conv_id", "turn", safe_title(F.substring("content", 1, 40), F.concat(F.lit("chat-"), F.col("conv_id").cast("string"))).alias("title"))
    return rows


def path_dedupe_suffix(spark, d):
    title = safe_title(F.substring("content", 1, 40), F.concat(F.lit("chat-"), F.col("conv_id").cast("string")))
    notes = model.messages(spark, d).select("conv_id", "turn", F.concat(F.lit("chats/"), "role").alias("folder"), title.alias("title"))
    return conversations.note_paths(notes, "folder", "title", ["conv_id", "turn"], bucket=F.expr("conv_id div 1000")).select("conv_id", "turn", "path")


def _nested_names(spark, d, separator: str, number: int) -> tuple[DataFrame, DataFrame]:
    """Items of three names for each source, of which the second is the first with a number and the third the second, and names that stand already."""
    more = f"{separator}{number}"
    docs = model.table(spark, d, "documents").select("doc_id", "source")
    suffix = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, more).otherwise(more + more)
    taken = docs.filter(F.col("doc_id") % 7 == 0).select(F.concat("source", F.lit(f"/note{separator}"), (F.col("doc_id") % 5 + 3).cast("string")).alias("name")).distinct()
    return docs.select("doc_id", "source", F.concat(F.lit("note"), suffix).alias("title")), taken


def capture_names(spark, d):
    """Names of captures some of which look like others with a number, in a folder that holds some."""
    items, taken = _nested_names(spark, d, "_", 1)
    rows = items.select("doc_id", F.concat("source", F.lit("/"), "title").alias("name"), F.lit(".txt").alias("ext"))
    return ledger.free_names(rows, "name", "ext", taken.select(F.concat("name", F.lit(".txt")).alias("file_name")), ["doc_id"]).select("doc_id", "file_name")


def note_names(spark, d):
    """The same of notes, numbered from 2."""
    items, taken = _nested_names(spark, d, "-", 2)
    return conversations.note_paths(items, "source", "title", ["doc_id"], F.expr("doc_id div 1000"), taken.select(F.concat("name", F.lit(".md")).alias("file_name"))).select("doc_id", "path")


def _names_sql(separator: str, number: int, extension: str, name: str) -> str:
    """Item by item: each takes the first name that no taken one and no earlier item has."""
    more = f"{separator}{number}"
    return f"""WITH RECURSIVE items AS (SELECT doc_id, source, source || '/note' || (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{more}' ELSE '{more}{more}' END) AS base, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
        deal AS (SELECT source, 0::BIGINT AS r, NULL::BIGINT AS doc_id, NULL::VARCHAR AS {name}, coalesce(list(DISTINCT source || '/note{separator}' || (doc_id % 5 + 3) || '{extension}') FILTER (doc_id % 7 = 0), []::VARCHAR[]) AS used FROM documents GROUP BY source
            UNION ALL SELECT source, r, doc_id, x, list_append(used, x) FROM (SELECT i.source, i.r, i.doc_id, d.used,
                list_filter(list_transform(range(0, d.r + 8), lambda k: i.base || (CASE WHEN k > 0 THEN '{separator}' || (k + {number - 1}) ELSE '' END) || '{extension}'), lambda c: NOT list_contains(d.used, c))[1] AS x FROM deal d JOIN items i ON i.source = d.source AND i.r = d.r + 1))
        SELECT doc_id, {name} FROM deal WHERE doc_id IS NOT NULL"""


def capture_types(spark, d):
    kinds = F.array(*map(F.lit, ("md", "TXT", "mp3", "png", "pdf", "json", "bin")))
    rows = model.files(spark, d).select("file_id", F.concat("title", F.lit("."), F.element_at(kinds, (F.col("file_id") % 7 + 1).cast("int"))).alias("name"))
    return rows.groupBy(content_type(F.col("name")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


def _blocks(spark, d):
    text = F.col("text")
    a, b = F.lit("<!-- NOTE:START -->"), F.lit("<!-- NOTE:END -->")
    body = text
    made = F.when(F.col("file_id") % 4 == 0, body).when(F.col("file_id") % 4 == 1, F.concat(body, a, F.lit("old"), b, F.lit(" tail"))).when(F.col("file_id") % 4 == 2, F.concat(b, body, a)).otherwise(F.concat(a, F.lit("x"), b, body, a, F.lit("y"), b))
    return model.files(spark, d).select("file_id", made.alias("text"))


def marker_block_status(spark, d):
    rows = conversations.replace_block(_blocks(spark, d), "<!-- NOTE:START -->", "<!-- NOTE:END -->", F.lit("fresh"))
    return rows.select("file_id", "status", F.md5("text").alias("md5"))


_MARKERS = r"""f AS (SELECT doc_id AS file_id, coalesce(text, '') AS body FROM documents),
    t AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'recovered' END AS status,
        CASE WHEN file_id % 4 = 1 THEN body || '<!-- NOTE:START -->' || chr(10) || 'fresh' || chr(10) || '<!-- NOTE:END --> tail'
        ELSE regexp_replace(body, '\s+$', '') || chr(10) || chr(10) || '<!-- NOTE:START -->' || chr(10) || 'fresh' || chr(10) || '<!-- NOTE:END -->' || chr(10) END AS text FROM f)"""

_M = "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations)"
_TITLES = r"""bare AS (SELECT conv_id, turn, role, trim(regexp_replace(content[:40], '[^\p{L}\p{N} _-]', '', 'g')) AS title FROM m),
    titles AS (SELECT conv_id, turn, role, CASE WHEN title = '' THEN 'chat-' || conv_id ELSE title END AS title FROM bare)"""
QUERIES = {
    "route_rule": (route_rule, f"{_KC} SELECT capture_id, label, confidence, ambiguous FROM rules"),
    "route_rule_gate_counts": (route_rule_gate_counts, f"{_KC} SELECT label, confidence >= 0.7 AS routed, count(*) AS n FROM rules GROUP BY ALL"),
    "route_model_confidence": (route_model_confidence, f"{_KC} SELECT capture_id, label, model_confidence AS confidence FROM hashed"),
    "route_hybrid_choice": (route_hybrid_choice, f"{_KC} SELECT capture_id, label, CASE WHEN confidence >= 0.75 THEN confidence ELSE model_confidence END AS confidence, CASE WHEN confidence >= 0.75 THEN 'rule' ELSE 'model' END AS engine FROM hashed"),
    "route_notes": (route_notes, f"{_NOTES}, {_sql_counts()}, {_ACTIONS} SELECT capture_id, label, confidence, ambiguous, CASE WHEN label = 'UNKNOWN' THEN '' ELSE coalesce((SELECT string_agg(action, '|' ORDER BY pos) FROM e WHERE e.capture_id = rules.capture_id), '') END AS next_actions FROM rules"),
    "intent_cascade": (intent_cascade, _intent_sql()),
    "extract_actions": (extract_actions, f"{_NOTES}, {_ACTIONS} SELECT capture_id, pos, action FROM e"),
    "conversation_destination": (conversation_destination, _destination_sql()),
    "conversation_sticky_route": (conversation_sticky_route, f"WITH x AS ({_destination_sql()}) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'tooling' ELSE destination END AS destination FROM x"),
    "conversation_content_hash": (conversation_content_hash, f"{_M} SELECT conv_id, sha256(conv_id || '|' || arg_min(content, turn)[:40] || '|' || string_agg(role || '|' || content, '|' ORDER BY turn, role, content)) AS content_hash FROM m GROUP BY conv_id"),
    "messages_sorted_filtered": (messages_sorted_filtered, f"{_M} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) AS pos, role, md5(content) AS md5 FROM m WHERE role IN ('user', 'assistant') AND trim(content) != ''"),
    "transcript_segment_dedupe": (transcript_segment_dedupe, "SELECT DISTINCT conv_id || '_seg_' || (turn % 3) AS segment_id FROM conversations WHERE conv_id % 2 != 0"),
    "export_normalised": (export_normalised, f"{_M}, k AS (SELECT conv_id, turn, role, trim(content) AS content FROM m WHERE role IN ('user', 'assistant') AND trim(content) != '') SELECT 'conv-' || m.conv_id AS conversation_id, count(k.turn) AS n, {model.EPOCH}::BIGINT AS created, md5(coalesce(string_agg(k.role || ':' || k.content, chr(10) ORDER BY k.turn), '')) AS md5 FROM (SELECT DISTINCT conv_id FROM m) m LEFT JOIN k ON k.conv_id = m.conv_id GROUP BY m.conv_id"),
    "distill_summary": (distill_summary, f"{_C}, {_SUMMARY} SELECT capture_id, summary, confidence FROM sm"),
    "distill_key_points": (distill_key_points, rf"""{_C}, l AS (SELECT capture_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '')[:5]) AS line, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '')[:5], 1) AS k FROM captures)
        SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY k) - 1)::INT AS pos, line[:100] AS point FROM l WHERE length(line) > 10"""),
    "distill_tasks": (distill_tasks, f"{_NOTES}, {_TASKS} SELECT capture_id, pos, text, priority FROM t"),
    "distill_entities": (distill_entities, f"{_C}, {_ENTITIES} SELECT capture_id, ord, name, kind FROM ent"),
    "proposal_fanout": (proposal_fanout, f"""{_NOTES}, {_TASKS}, {_SUMMARY}, {_ENTITIES}, nt AS (SELECT capture_id, count(*) AS n FROM t GROUP BY 1)
        SELECT capture_id, 0::BIGINT AS ord, 'note' AS artifact_type, summary[:80] AS title, round(confidence, 4) AS confidence FROM sm
        UNION ALL SELECT t.capture_id, pos + 1, 'task', t.text[:80], round(confidence * 0.9::DOUBLE, 4) FROM t JOIN sm ON sm.capture_id = t.capture_id
        UNION ALL SELECT ent.capture_id, coalesce(n, 0) + ord, 'entity', name[:80], round(confidence * 0.8::DOUBLE, 4) FROM ent JOIN sm ON sm.capture_id = ent.capture_id LEFT JOIN nt ON nt.capture_id = ent.capture_id"""),
    "todo_substring_antijoin": (todo_substring_antijoin, f"{_NOTES}, {_TASKS}, todo AS MATERIALIZED (SELECT DISTINCT {_said_sql('text')} AS todo FROM benchmark WHERE text IS NOT NULL) SELECT capture_id, pos, text FROM t WHERE NOT EXISTS (SELECT 1 FROM todo WHERE contains(todo, t.text))"),
    "entity_dedupe_antijoin": (entity_dedupe_antijoin, f"{_C}, {_ENTITIES}, known AS (SELECT DISTINCT lower(name) AS low, kind FROM ent WHERE length(name) % 2 = 0) SELECT name, kind, capture_id FROM ent WHERE (lower(name), kind) NOT IN (SELECT (low, kind) FROM known) QUALIFY row_number() OVER (PARTITION BY lower(name), kind ORDER BY capture_id, ord) = 1"),
    "salience_lines": (salience_lines, f"{model.with_sql('lines')}, r AS (SELECT file_id, line, trim(regexp_replace(text, '\\b[Ww]hat of\\b|\\b[Bb]y the\\b', 'next', 'g')) AS bare FROM lines), s AS (SELECT file_id, line, bare, lower(replace(bare, '’', chr(39))) AS low FROM r) SELECT file_id, line FROM s WHERE bare != '' AND (contains(bare, '?') OR bare[1] IN ('-', '*', '•') OR contains(low, 'i realized') OR contains(low, 'the point is') OR contains(low, 'what i''m saying') OR contains(low, 'decision') OR contains(low, 'so i''m going to') OR contains(low, 'next') OR contains(low, 'action') OR contains(low, 'summary'))"),
    "safe_titles": (safe_titles, f"{_M}, {_TITLES} SELECT conv_id, turn, title FROM titles"),
    "capture_names": (capture_names, _names_sql("_", 1, ".txt", "file_name")),
    "note_names": (note_names, _names_sql("-", 2, ".md", "path")),
    "path_dedupe_suffix": (path_dedupe_suffix, f"{_M}, {_TITLES}, n AS (SELECT conv_id, turn, 'chats/' || role AS folder, title, row_number() OVER (PARTITION BY role, title ORDER BY conv_id, turn) AS n FROM titles) SELECT conv_id, turn, folder || '/' || title || (CASE WHEN n > 1 THEN '-' || n ELSE '' END) || '.md' AS path FROM n"),
    "capture_types": (capture_types, "SELECT ['markdown', 'text', 'audio', 'image', 'pdf', 'json', 'other'][doc_id % 7 + 1] AS content_type, count(*) AS n FROM documents GROUP BY 1"),
    "marker_block_status": (marker_block_status, f"WITH {_MARKERS} SELECT file_id, status, md5(text) AS md5 FROM t"),
}
