"""Review: the queue of proposals, what approval and correction write where, the events that are logged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import STATUS

#: Where approved artifacts go: path (with {day} and {id}, the first eight characters of the proposal's), what a new file begins with.
TODO, PRINCIPLES, ENTITIES = "30_tasks/todo.md", "20_memory/principles.md", "20_memory/entities.json"
DAILY, DECISIONS = "20_memory/daily/{day}.md", "50_corrections/decisions/decision_{day}_{id}.md"


def pending(queue: DataFrame, limit: int | None = None, status: str = "pending") -> DataFrame:
    """Items of a status in the order in which they were queued (seq); a limit of 0 is none."""
    rows = queue.filter(F.col("status") == status)
    return rows.orderBy("seq").limit(limit) if limit else rows


def bootstrap(queue: DataFrame, generated: DataFrame) -> DataFrame:
    """The pending items, or, if there are none, the generated proposals as new ones; both have the queue's columns but status."""
    waiting = pending(queue)
    none = waiting.agg(F.count(F.lit(1)).alias("n"))
    columns = [c for c in queue.columns if c != "status"]
    new = generated.select(columns).withColumn("__waiting", none.scalar()).filter("__waiting = 0").drop("__waiting")
    return waiting.select(columns).unionByName(new).withColumn("status", F.lit("pending"))


def from_artifacts(artifacts: DataFrame, day: str) -> DataFrame:
    """Proposals of distilled artifacts (capture_id, summary, confidence, tasks, entities, file): a note, each task at 0.9, each entity at 0.8 of the confidence.

    proposal_id, capture_id, ord, artifact_type, title, content, destination, confidence, source_file. Ids are a hash of what
    they stand for, so a repeated run proposes the same; an artifact without a confidence has 0.5.
    """

    def item(kind: str, title: Column, content: Column, destination: str, share: float) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"), title.cast("string").alias("title"), content.alias("content"), F.lit(destination).alias("destination"), F.lit(share).alias("share"))

    note = F.array(item("note", F.concat(F.lit("Distill: "), F.substring(F.coalesce("capture_id", F.lit("unknown")), 1, 8)), F.coalesce("summary", F.lit("")), DAILY.format(day=day), 1.0))
    none = "array<struct<artifact_type:string,title:string,content:string,destination:string,share:double>>"
    todo = F.coalesce(F.transform("tasks", lambda t: item("task", F.lit(None), F.coalesce(t["text"], F.lit("")), TODO, 0.9)), F.array().cast(none))
    people = F.coalesce(F.transform("entities", lambda e: item("entity", e["name"], F.to_json(e), ENTITIES, 0.8)), F.array().cast(none))
    rows = artifacts.select("capture_id", "file", F.coalesce("confidence", F.lit(0.5)).alias("own"), F.posexplode(F.concat(note, todo, people)).alias("ord", "p"))
    ident = F.sha2(F.concat_ws("|", "capture_id", "file", F.col("ord").cast("string"), "p.artifact_type", "p.content"), 256)
    return rows.select(ident.alias("proposal_id"), "capture_id", "ord", "p.artifact_type", "p.title", "p.content", "p.destination", F.round(F.col("own") * F.col("p.share"), 4).alias("confidence"), F.col("file").alias("source_file"))


def _titled(mark: str, between: str, fallback: str = "") -> Column:
    return F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(mark), "title", F.lit(between))).otherwise(F.lit(fallback))


def dispatch(approved: DataFrame, day: str) -> DataFrame:
    """(proposal_id, path, mode, header, text): what an approved proposal (proposal_id, artifact_type, title, content, destination) writes.

    Tasks, principles, memories and entities are appended to their file, which begins with the header if it is new; notes
    and decisions are files of their own, and so is any other type, at its destination. An entity's content is a JSON
    object, or else a name.
    """
    ident = F.substring("proposal_id", 1, 8)
    daily, decision = F.lit(DAILY.format(day=day)), F.concat(F.lit(DECISIONS.split("{id}")[0].format(day=day)), ident, F.lit(".md"))
    own = F.when(F.coalesce("destination", F.lit("")) != "", F.col("destination"))
    note = F.coalesce(own, F.concat(F.lit("20_memory/daily/note_"), ident, F.lit(f"_{day}.md")))
    given = F.try_parse_json("content")
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.substring("content", 1, 50))
    entry = F.when(F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False)), F.col("content")).otherwise(F.to_json(F.struct(name.alias("name"), F.lit("topic").alias("kind"))))
    made = {
        "task": (F.lit(TODO), "append", "# Tasks\n\n", F.concat(F.lit("- [ ] "), _titled("**", "**: "), "content", F.lit("\n"))),
        "note": (note, "create", "", F.concat(_titled("# ", "\n\n"), "content")),
        "principle": (F.lit(PRINCIPLES), "append", "# Personal Principles\n", F.concat(F.lit("\n"), _titled("## ", "\n\n"), "content", F.lit("\n"))),
        "memory": (daily, "append", f"# Daily Notes — {day}\n", F.concat(F.lit("\n"), _titled("### ", "\n\n"), "content", F.lit("\n"))),
        "decision": (decision, "create", "", F.concat(_titled("# ", "", f"# Decision — {day}"), F.lit("\n\n"), "content")),
        "entity": (F.lit(ENTITIES), "append", "", F.concat(F.regexp_replace(F.rtrim(entry), r"\}$", ""), F.lit(f', "first_seen_at": "{day}", "last_seen_at": "{day}", "proposal_id": "'), "proposal_id", F.lit('"}'))),
    }
    other = (own, "create", "", F.col("content"))

    def pick(k: int) -> Column:
        value = lambda x: x if isinstance(x, Column) else F.lit(x)
        return reduce(lambda rest, m: F.when(F.col("artifact_type") == m[0], value(m[1][k])).otherwise(rest), made.items(), value(other[k]))

    return approved.select("proposal_id", pick(0).alias("path"), pick(1).alias("mode"), pick(2).alias("header"), pick(3).alias("text"))


def corrected(queue: DataFrame, corrections: DataFrame) -> DataFrame:
    """The proposals that corrections (proposal_id, seq, artifact_type, title, content, destination) make of queued ones, at confidence 1.

    The last correction of a proposal counts; without a destination it keeps the old one. The new proposal_id is a hash of the
    old one and the correction, override_id names the record; original_type says what it was.
    """
    last = corrections.groupBy("proposal_id").agg(F.max_by(F.struct("artifact_type", "title", "content", "destination", "seq"), "seq").alias("c"))
    rows = queue.select("proposal_id", "capture_id", F.col("artifact_type").alias("original_type"), F.col("destination").alias("__old")).join(last, "proposal_id")
    ident = F.sha2(F.concat_ws("|", "proposal_id", "c.artifact_type", "c.title", "c.content"), 256)
    return rows.select(ident.alias("override_id"), F.col("proposal_id").alias("corrects"), F.sha2(F.concat(F.lit("corrected|"), ident), 256).alias("proposal_id"), "capture_id", "original_type", "c.artifact_type", "c.title", "c.content", F.coalesce(F.nullif("c.destination", F.lit("")), "__old").alias("destination"), F.concat(F.lit("Corrected from "), F.substring("proposal_id", 1, 8)).alias("rationale"), F.lit(1.0).alias("confidence"))


def override_records(fixed: DataFrame, day: str) -> DataFrame:
    """(path, text): the JSON record of each correction."""
    return fixed.select(F.concat(F.lit(f"50_corrections/overrides/{day}/"), "override_id", F.lit(".json")).alias("path"), F.to_json(F.struct("override_id", "corrects", "original_type", "artifact_type", "title", "content", "destination")).alias("text"))


def events(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """(event_type, capture_id, payload): a learning event for each action that does something, numbered by deferral where it defers."""
    known = actions.filter(F.col("action").isin(*STATUS)).join(queue.select(F.col("proposal_id").alias("item_id"), "capture_id", "artifact_type"), "item_id")
    told = reduce(lambda rest, s: F.when(F.col("action") == s[0], f"REVIEW_{s[1].upper()}").otherwise(rest), STATUS.items(), F.lit(None).cast("string"))
    return known.select(told.alias("event_type"), "capture_id", F.create_map(F.lit("proposal_id"), F.col("item_id").cast("string"), F.lit("artifact_type"), "artifact_type", F.lit("seq"), F.col("seq").cast("string")).alias("payload"))


def files_after(files: DataFrame, made: DataFrame, order: str = "proposal_id") -> DataFrame:
    """(path, text) of the files that dispatched writes change or create. files: path, text as they are.

    Appended texts follow what is there, or the header, in the given order; of several whole texts for one path the last
    stands. The entity store is a JSON array that grows; one that is no array begins anew.
    """
    parts = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "mode", "header", F.col("text").alias("x")))).alias("parts"))
    rows = parts.join(files, "path", "left")
    whole = F.element_at("parts", -1)
    appended = F.concat(F.coalesce("text", whole["header"]), F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    old = F.when(F.schema_of_variant(F.try_parse_json("text")).startswith("ARRAY"), F.regexp_replace("text", r"(?s)^\s*\[\s*|\s*\]\s*$", ""))
    store = F.concat(F.lit("["), F.concat_ws(", ", F.nullif(old, F.lit("")), F.array_join(F.transform("parts", lambda p: p["x"]), ", ")), F.lit("]"))
    return rows.select("path", F.when(F.col("path") == ENTITIES, store).when(whole["mode"] == "create", whole["x"]).otherwise(appended).alias("text"))
