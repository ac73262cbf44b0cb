"""Routing and classification of captures and conversations, as Column expressions without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import actions, hash_share

# Keywords of each label, in the order in which ties are decided.
KEYWORDS = {
    "TASK": ("todo", "task", "need to", "must", "should", "action", "deadline", "reminder", "complete", "finish", "do this"),
    "IDEA": ("idea", "maybe", "consider", "thought", "concept", "brainstorm", "what if", "could try", "potential"),
    "JOURNAL": ("today", "feeling", "experienced", "noticed", "realized", "grateful", "yesterday", "this morning", "reflection"),
    "PEOPLE": ("met with", "call with", "talked to", "email from", "discussion with", "spoke to", "conversation with", "meeting"),
    "ADMIN": ("expense", "receipt", "invoice", "appointment", "scheduled", "booking", "payment", "bill"),
}

# The intents' patterns, tried in this order, and the agent of each intent.
INTENTS = (
    (r"(?i)^(todo:|make a plan|steps|roadmap)", "task_generation"),
    (r"(?i)(should I|compare|pros and cons|which is better)", "decision_support"),
    (r"(?i)(run|execute|call|search my vault|create file|invoke tool)", "execution"),
    (r"(?i)(I feel|I'm thinking about|processing)", "reflect"),
    (r"(?i)(remember that|save this|add to vault|update note)", "knowledge_update"),
)
AGENTS = {"reflect": "ReflectionAgent", "knowledge_update": "KnowledgeGardenAgent", "task_generation": "PlannerAgent", "decision_support": "AnalystAgent", "execution": "ToolAgent", "ignore": "NullAgent"}
FILLERS = ("ok", "lol", "nice", "thanks")

# Signs of a conversation about tools.
TOOL_WORDS = ("python", "pip", "venv", "pytest", "conda", "import", "traceback", "exception", "stack trace", "error", "bug", "sql", "regex", "typescript", "javascript", "node", "npm", "yarn", "docker", "bash", "zsh", "powershell", "git", "merge", "rebase", "fastapi", "langchain", "pydantic", "databricks", "api", "http", "json", "yaml")
TRACES = (r"traceback \(most recent call last\)", r"\bexception:\b", r"\berror:\b", r"\bstack trace\b", r'file ".*", line \d+')
TITLE_STARTS = ("how", "fix", "error", "bug", "help")


def keyword_counts(text: Column) -> dict[str, Column]:
    """How many of each label's keywords the text contains."""
    low = F.lower(text)
    return {label: sum((F.when(low.contains(k), 1).otherwise(0) for k in words), F.lit(0)) for label, words in KEYWORDS.items()}


def _with_counts(df: DataFrame, text: str) -> DataFrame:
    """df with n_<label> for each label, best (the largest), label (the first with it, null for none), clear text length."""
    df = df.withColumns({f"n_{k}": v for k, v in keyword_counts(F.col(text)).items()})
    df = df.withColumn("best", F.greatest(*[F.col(f"n_{k}") for k in KEYWORDS]))
    pick = reduce(lambda rest, k: F.when(F.col(f"n_{k}") == F.col("best"), k).otherwise(rest), reversed(list(KEYWORDS)), F.lit(None).cast("string"))
    return df.withColumn("top", F.when(F.col("best") > 0, pick)).withColumn("short", F.char_length(F.regexp_replace(F.col(text), r"^\s+|\s+$", "")) < 5)


def route_by_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with label, confidence, ambiguous, next_actions by keyword counts.

    A label is ambiguous if another has at least 0.7 times its count. Texts under five characters are UNKNOWN at 0.1, texts
    without a keyword UNKNOWN at 0.3.
    """
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    rows = _with_counts(df, text)
    rivals = sum((F.when((F.col(f"n_{k}") > 0) & (F.col(f"n_{k}") >= F.col("best") * 0.7), 1).otherwise(0) for k in KEYWORDS), F.lit(0))
    rows = rows.withColumn("ambiguous", F.coalesce((F.col("best") > 0) & ~F.col("short") & (rivals > 1), F.lit(False)))
    # Confidence by how many keywords were found.
    ladder = F.when(F.col("best") == 1, F.when(F.col("ambiguous"), 0.5).otherwise(0.6)).when(F.col("best") == 2, F.when(F.col("ambiguous"), 0.65).otherwise(0.75)).otherwise(F.when(F.col("ambiguous"), 0.75).otherwise(0.9))
    known = ~F.col("short") & (F.col("best") > 0)
    return rows.select(
        *[F.col(c) for c in df.columns],
        F.when(known, F.col("top")).otherwise("UNKNOWN").alias("label"),
        F.when(F.col("short"), 0.1).when(F.col("best") == 0, 0.3).otherwise(ladder).alias("confidence"),
        "ambiguous",
        F.when(known, actions(F.col(text))).otherwise(F.array().cast("array<string>")).alias("next_actions"),
    )


def route_by_hash(df: DataFrame, text: str = "text") -> DataFrame:
    """df with label and confidence of the deterministic stand-in for a language model: the keywords' label, confidence by the text's hash."""
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    rows = _with_counts(df, text).withColumn("base", F.lit(0.6) + hash_share(F.col(text)) * 0.35)
    known = ~F.col("short") & (F.col("best") > 0)
    raised = F.when(F.col("best") >= 3, F.least(F.lit(0.95), F.col("base") + 0.15)).when(F.col("best") == 2, F.col("base") + 0.05).otherwise(F.col("base"))
    confidence = F.when(F.col("short"), 0.2).when(F.col("best") == 0, F.round(F.col("base") * 0.5, 2)).otherwise(F.round(raised, 2))
    return rows.select(*df.columns, F.when(known, F.col("top")).otherwise("UNKNOWN").alias("label"), confidence.alias("confidence"))


def route_hybrid(df: DataFrame, text: str = "text", threshold: float = 0.9, force_model: bool = False, model: Callable[[DataFrame, str], DataFrame] = route_by_hash) -> DataFrame:
    """The rules' result where its confidence reaches the threshold, else the model's; engine says whose.

    model adds label and confidence to a DataFrame, as a call to a language model would.
    """
    rules = route_by_rules(df, text).withColumnsRenamed({"label": "rule_label", "confidence": "rule_confidence"})
    both = model(rules, text)
    sure = F.lit(False) if force_model else F.col("rule_confidence") >= threshold
    return both.select(*df.columns, F.when(sure, F.col("rule_label")).otherwise(F.col("label")).alias("label"), F.when(sure, F.col("rule_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(sure, "rule").otherwise("model").alias("engine"))


def _plain_answer(text: Column) -> Column:
    """A model's answer as a variant, out of a fence if it stands in one; null if it isn't a JSON object."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    v = F.try_parse_json(F.regexp_replace(bare, r"(?s)\A```[^\n]*\n(.*?)(?:\n?```)?\z", "$1"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _get(v: str, key: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{key}', '{kind}')")


def _texts(v: str, key: str, most: int, chars: int) -> Column:
    found = F.coalesce(_get(v, key, "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.slice(found, 1, most), lambda x: F.substring(x, 1, chars))


def coerce_route(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with label, confidence, next_actions, reasoning as a model's answer gives them, made sound.

    A label that isn't known is UNKNOWN; the confidence is 0.5 without one, held between 0 and 1 and rounded; at most three
    actions of 200 characters; reasoning of 200. An answer that can't be read is UNKNOWN at 0.3 and says so.
    """
    rows = df.withColumn("__v", _plain_answer(F.col(answer)))
    bad = F.col("__v").isNull()
    label = F.upper(_get("__v", "route_label"))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get("__v", "confidence", "double"), F.lit(0.5)))), 2)
    return rows.withColumns({
        "label": F.when(~bad & label.isin(*KEYWORDS), label).otherwise("UNKNOWN"),
        "confidence": F.when(bad, 0.3).otherwise(confidence),
        "next_actions": F.when(bad, F.array().cast("array<string>")).otherwise(_texts("__v", "next_actions", 3, 200)),
        "reasoning": F.when(bad, "JSON parse error from LLM response").otherwise(F.substring(F.coalesce(_get("__v", "reasoning"), F.lit("")), 1, 200)),
    }).drop("__v")


# Kinds of entities and priorities of tasks that an answer may name.
ENTITY_KINDS, PRIORITIES = ("person", "project", "tool", "topic"), ("low", "med", "high")


def coerce_distill(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with summary, key_points, tasks, entities, confidence, reasoning as a model's answer gives them, made sound.

    Summary of 500 characters, five points of 200, seven tasks of 200 (a priority that isn't known is med), seven entities of
    100 characters, those of unknown kind left out. An answer that can't be read has confidence 0.3 and says so.
    """
    rows = df.withColumn("__v", _plain_answer(F.col(answer)))
    bad = F.col("__v").isNull()
    tasks = F.slice(F.coalesce(_get("__v", "tasks", "array<struct<text:string,priority:string,due_date:string>>"), F.array().cast("array<struct<text:string,priority:string,due_date:string>>")), 1, 7)
    tasks = F.transform(tasks, lambda t: F.struct(F.substring(F.coalesce(t["text"], F.lit("")), 1, 200).alias("text"), F.when(t["priority"].isin(*PRIORITIES), t["priority"]).otherwise("med").alias("priority"), t["due_date"].alias("due_date")))
    people = F.slice(F.coalesce(_get("__v", "entities", "array<struct<name:string,kind:string,note:string>>"), F.array().cast("array<struct<name:string,kind:string,note:string>>")), 1, 7)
    people = F.transform(people, lambda e: F.struct(F.substring(F.coalesce(e["name"], F.lit("")), 1, 100).alias("name"), F.coalesce(e["kind"], F.lit("topic")).alias("kind"), e["note"].alias("note")))
    return rows.withColumns({
        "summary": F.when(bad, "Failed to parse LLM response").otherwise(F.substring(F.coalesce(_get("__v", "summary"), F.lit("")), 1, 500)),
        "key_points": _texts("__v", "key_points", 5, 200),
        "tasks": tasks,
        "entities": F.filter(people, lambda e: e["kind"].isin(*ENTITY_KINDS)),
        "confidence": F.when(bad, 0.3).otherwise(F.coalesce(_get("__v", "confidence", "double"), F.lit(0.7))),
        "reasoning": F.when(bad, "JSON parse error from LLM response").otherwise(F.substring(F.coalesce(_get("__v", "reasoning"), F.lit("")), 1, 200)),
    }).drop("__v")


def routed_outputs(df: DataFrame, day: str, ts: str, least: float = 0.7) -> DataFrame:
    """(capture_id, path, text, event_type, payload): the JSON artifact of each routed capture, under routed or, below the gate, under review_queue with the reason.

    df: capture_id, label, confidence, next_actions, raw_path, meta_path. One artifact for each capture_id; see free_names() for folders that hold some.
    """
    low = F.col("confidence") < least
    reason = F.concat(F.lit("Confidence "), F.format_number("confidence", 2), F.lit(f" below threshold {least:.2f}"))
    path = F.concat(F.when(low, f"10_derived/review_queue/{day}/").otherwise(f"10_derived/routed/{day}/"), "capture_id", F.lit(".json"))
    text = F.to_json(F.struct("capture_id", F.when(~low, ts).alias("routed_at"), F.when(low, ts).alias("flagged_at"), F.col("label").alias("route_label"), "confidence", "next_actions", F.when(low, reason).alias("review_reason"), F.col("raw_path").alias("raw_file_path"), F.col("meta_path").alias("meta_file_path")))
    payload = F.map_filter(F.create_map(F.lit("route"), "label", F.lit("confidence"), F.col("confidence").cast("string"), F.lit("path"), path, F.lit("review_reason"), F.when(low, reason)), lambda _, v: v.isNotNull())
    return df.select("capture_id", path.alias("path"), text.alias("text"), F.lit("CAPTURE_ROUTED").alias("event_type"), payload.alias("payload"))


def gate(df: DataFrame, least: float = 0.7) -> DataFrame:
    """df with routed: does the confidence reach the gate, or is the capture to be reviewed."""
    return df.withColumn("routed", F.col("confidence") >= least)


def intent(df: DataFrame, text: str = "text") -> DataFrame:
    """df with intent, confidence and agent: the first pattern that is found, then fillers, else reflection at 0.5."""
    value = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    hard = reduce(lambda rest, p: F.when(value.rlike(p[0]), p[1]).otherwise(rest), reversed(INTENTS), F.when(F.lower(bare).isin(*FILLERS), "ignore"))
    agent = reduce(lambda rest, p: F.when(F.col("intent") == p[0], p[1]).otherwise(rest), AGENTS.items(), F.lit("NullAgent"))
    rows = df.withColumn("hard", hard).withColumn("intent", F.coalesce("hard", F.lit("reflect")))
    return rows.withColumn("confidence", F.when(F.col("hard").isNotNull(), 0.99).otherwise(0.5)).withColumn("agent", agent).drop("hard")


def code_stats(text: Column) -> tuple[Column, Column]:
    """Number of closed code fences; characters between them as a share of all."""
    parts = F.split(text, "```")
    inside = F.aggregate(F.filter(parts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + F.char_length(x))
    size = F.char_length(text)
    return F.floor(F.size(parts) / 2).cast("long"), F.when(size > 0, inside / size).otherwise(0.0)


def destination(conversations: DataFrame, mode: str = "heuristic", fences: int = 2, share: float = 0.25) -> DataFrame:
    """conv_id, destination and its signals for conversations (conv_id, title, text, n_messages, mean_chars)."""
    if mode != "heuristic":
        return conversations.select("conv_id", F.lit(mode.removeprefix("force-")).alias("destination"))
    whole = F.concat_ws("\n", F.coalesce("title", F.lit("")), "text")
    low = F.lower(whole)
    count, ratio = code_stats(whole)
    word = reduce(lambda a, b: a | b, [low.contains(k) for k in TOOL_WORDS])
    trace = reduce(lambda a, b: a | b, [low.rlike(p) for p in TRACES])
    start = F.lower(F.trim(F.coalesce("title", F.lit("")))).rlike("^(" + "|".join(TITLE_STARTS) + ")")
    quick = (F.col("n_messages") >= 6) & (F.col("mean_chars") <= 120)
    rows = conversations.select("conv_id", count.alias("fences"), F.round(ratio, 6).alias("code_share"), word.alias("tool_word"), trace.alias("trace"), start.alias("title_start"), quick.alias("short_iterative"))
    tool = (F.col("fences") >= fences) | (F.col("code_share") >= share) | F.col("trace") | (F.col("tool_word") & (F.col("title_start") | F.col("short_iterative")))
    return rows.withColumn("destination", F.when(tool, "tooling").otherwise("daemon"))


def sticky(classified: DataFrame, stored: DataFrame, reclassify: bool = False) -> DataFrame:
    """A stored destination wins over a new one unless all are to be classified again."""
    joined = classified.join(stored.select("conv_id", F.col("destination").alias("stored")), "conv_id", "left")
    return joined if reclassify else joined.withColumn("destination", F.coalesce("stored", "destination"))
