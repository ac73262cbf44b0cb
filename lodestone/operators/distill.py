"""Distilling captures: summary, key points, tasks, entities, proposals; what is already known is left out; undo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import work_folder
from ..functions.text import SPACES, hash_share, is_salient, let, strip
from .notes import BEGIN, CLOSE, daily_block, mark, todo_block
from .substrings import standing

# What introduces a task, what decides its priority, what tells an entity's kind.
TRIGGERS = ("need to", "must", "should", "todo:", "action:")
URGENT, LATER = ("urgent", "asap"), ("eventually", "someday")
COMMON = ("the", "this", "that", "what", "when", "where", "i", "a", "an")
KINDS = (("PERSON", ("met", "call", "talk", "email", "@")), ("PROJECT", ("project", "build", "working on")), ("TOOL", ("using", "tool", "app", "software")))


def confidence(text: Column) -> Column:
    return F.round(F.lit(0.7) + hash_share(text) * 0.25, 2)


def summary(text: Column) -> Column:
    """The first sentence if it ends within 200 characters (a full stop is looked for first, then !, then ?), else the first 150 characters."""

    def of(bare: Column) -> Column:
        cut = F.when(F.char_length(bare) > 150, F.concat(F.substring(bare, 1, 147), F.lit("..."))).otherwise(bare)
        for mark in ("?", "!", "."):
            at = F.instr(bare, mark)
            cut = F.when(at > 1, F.substring(bare, F.lit(1), at)).otherwise(cut)
        return F.when(bare == "", "Empty capture.").otherwise(cut)

    return let(F.substring(strip(F.coalesce(text, F.lit(""))), 1, 200), of)


def key_points(text: Column) -> Column:
    """Of the first five lines that aren't blank, those of more than ten characters, cut at 100."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    return F.transform(F.filter(F.slice(lines, 1, 5), lambda x: F.char_length(x) > 10), lambda x: F.substring(x, 1, 100))


def tasks(text: Column, most: int = 7) -> Column:
    """array of (text, priority): up to `most`, one for each line, from behind the first trigger that the line has.

    The trigger is found in the stripped line and its place applied to the line as it is, as users of the pipeline expect.
    The fold looks at no line behind the last task that counts, and at each part of a line once.
    """

    def of(line: Column, low: Column) -> Column:
        def behind(trigger: str) -> Column:
            rest = let(F.instr(low, trigger), lambda at: F.when(at > 0, F.rtrim(strip(F.substring(line, at + len(trigger), 1_000_000_000)), F.lit(".,;:"))))
            return let(rest, lambda r: F.when(F.char_length(r) > 3, F.substring(r, 1, 200)))

        urgent = reduce(lambda a, b: a | b, [low.contains(k) for k in URGENT])
        later = reduce(lambda a, b: a | b, [low.contains(k) for k in LATER])
        level = F.when(urgent, "high").when(later, "low").otherwise("med")
        return let(F.coalesce(*map(behind, TRIGGERS)), lambda t: F.when(t.isNotNull(), F.struct(t.alias("text"), level.alias("priority"))))

    def step(kept: Column, line: Column) -> Column:
        more = let(let(strip(F.lower(line)), lambda low: of(line, low)), lambda t: F.when(t.isNull(), kept).otherwise(F.array_append(kept, t)))
        return F.when(F.size(kept) >= most, kept).otherwise(more)

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), F.array().cast("array<struct<text:string,priority:string>>"), step)


#: Words that entity_array() looks at first, and then; all others only if these hold too few names.
FIRST_WORDS = (96, 768)


def entity_array(text: Column, most: int = 7, first: tuple[int, ...] = FIRST_WORDS) -> Column:
    """array of (name, kind): up to `most` capitalised words, each name once whatever its case, kind by the two words before.

    Only places of words that qualify are folded over, and the fold keeps `most` of them, so nothing is shuffled or exploded.
    Names count in their order, so where the first 96 words, or 768, hold `most` of them the others change nothing and aren't split.
    """
    def bare(word: Column) -> Column:
        return F.btrim(word, F.lit(".,;:!?\"'()[]"))

    def fits(word: Column) -> Column:
        return (F.char_length(word) >= 3) & word.rlike(r"^[.,;:!?\"'()\[\]]*\p{Lu}") & ~F.lower(bare(word)).isin(*COMMON)

    def of(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(fits(w), i)), lambda i: i.isNotNull())
        zero = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("low"))

        def step(kept: Column, i: Column) -> Column:
            low = F.lower(bare(F.get(words, i)))
            more = F.struct(F.array_append(kept["at"], i).alias("at"), F.array_append(kept["low"], low).alias("low"))
            return F.when((F.size(kept["at"]) >= most) | F.array_contains(kept["low"], low), kept).otherwise(more)

        def named(i: Column) -> Column:
            before = F.lower(F.array_join(F.slice(words, F.greatest(F.lit(1), i - 1), F.least(i, F.lit(2))), " "))
            kind = reduce(lambda rest, k: F.when(reduce(lambda a, b: a | b, [before.contains(w) for w in k[1]]), k[0]).otherwise(rest), reversed(KINDS), F.lit("TOPIC"))
            return F.struct(bare(F.get(words, i)).alias("name"), kind.alias("kind"))

        return F.transform(F.aggregate(places, zero, step, lambda s: s["at"]), named)

    whole, space = strip(F.coalesce(text, F.lit(""))), f"[{SPACES}]+"  # stripped, so no word is empty but that of an empty text

    def enough(n: int, rest: Column) -> Column:
        """What the first n words hold, or rest if that is too little."""
        return let(F.split(whole, space, n + 1), lambda words: let(let(F.slice(words, 1, n), of), lambda e: F.when((F.size(words) <= n) | (F.size(e) >= most), e).otherwise(rest)))

    return reduce(lambda rest, n: enough(n, rest), sorted(first, reverse=True), let(F.split(whole, space), of))


def entities(df: DataFrame, key: str = "capture_id", text: str = "text") -> DataFrame:
    """(key, ord, name, kind): entity_array() of each text, one row each."""
    rows = df.select(key, F.posexplode(entity_array(F.col(text))).alias("ord", "e"))
    return rows.select(key, (F.col("ord") + 1).alias("ord"), "e.name", "e.kind")


def proposals(df: DataFrame, key: str = "capture_id", text: str = "text") -> DataFrame:
    """(key, ord, artifact_type, title, content, confidence): one note of each text, its tasks at 0.9 and its entities at 0.8 of the confidence."""
    own = confidence(F.col(text))

    def item(kind: str, title: Column, content: Column, share: float) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"), F.substring(title, 1, 80).alias("title"), content.alias("content"), F.lit(share).alias("share"))

    note = F.array(item("note", F.col("__summary"), F.col("__summary"), 1.0))
    todo = F.transform(tasks(F.col(text)), lambda t: item("task", t["text"], t["text"], 0.9))
    people = F.transform(entity_array(F.col(text)), lambda e: item("entity", e["name"], F.to_json(e), 0.8))
    rows = df.withColumn("__summary", summary(F.col(text))).select(key, own.alias("own"), F.posexplode(F.concat(note, todo, people)).alias("ord", "p"))
    return rows.select(key, "ord", "p.artifact_type", "p.title", "p.content", F.round(F.col("own") * F.col("p.share"), 4).alias("confidence"))


def new_tasks(found: DataFrame, existing: DataFrame, task: str = "text", todo: str = "todo", gram: int = 16, **sizes) -> DataFrame:
    """Tasks whose text stands in no existing todo text. A null task is new; an empty one stands in any text.

    Texts are streamed through automata of the distinct tasks; sizes: see standing(). gram has no effect any more.
    The tasks are kept in a folder, as they are read four times: for their size, for the automata, for empty ones, and to be returned.
    """
    folder = f"{work_folder(found.sparkSession)}/tasks"
    found.write.parquet(folder)
    found = found.sparkSession.read.parquet(folder)
    known = standing(found, existing, task, todo, **sizes).withColumnRenamed("string", "__task")
    return found.join(known, F.col(task) == F.col("__task"), "left_anti")


def new_entities(found: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Entities (name, kind) not known yet, the first by the given columns of each name (whatever its case) and kind: an aggregate that combines before the shuffle."""
    first = found.groupBy(F.lower("name").alias("__low"), F.col("kind").alias("__kind")).agg(F.min_by(F.struct(*found.columns), F.struct(*order, *[c for c in found.columns if c not in order])).alias("__row"))
    old = known.select(F.lower("name").alias("__low"), F.col("kind").alias("__kind")).distinct()
    return first.join(old, ["__low", "__kind"], "left_anti").select("__row.*").select(*found.columns)


def salient_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_salient(F.col("text")))


def salience_input(df: DataFrame, most: int, text: str = "text") -> DataFrame:
    """df with salience: the text if it has at most `most` characters; else its first and last quarter of that and, between them, in order, the salient lines that still fit, joined by blank lines.

    The choice of lines is one fold over the document's own array of lines.
    """
    value, edge, gap = F.coalesce(F.col(text), F.lit("")), max(1, most // 4), 2
    size = F.char_length(value)
    parts = F.regexp_extract_all(value, F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    state = "struct<at:int,left:int,kept:array<string>>"  # what is kept has `most` characters at most, so the list stays short

    def step(s: Column, line: Column) -> Column:
        end = s["at"] + F.char_length(line)
        cost = F.char_length(line) + gap
        take = (s["at"] >= edge) & (end <= size - edge) & is_salient(F.regexp_replace(line, r"\s+$", "")) & (cost <= s["left"])
        return F.struct(end.alias("at"), F.when(take, s["left"] - cost).otherwise(s["left"]).alias("left"), F.when(take, F.array_append(s["kept"], line)).otherwise(s["kept"]).alias("kept")).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.lit(most - 2 * edge - gap).alias("left"), F.array().cast("array<string>").alias("kept")).cast(state)
    picked = F.aggregate(parts, zero, step, lambda s: s["kept"])
    joined = F.array_join(F.concat(F.array(F.substring(value, 1, edge)), picked, F.array(F.substring(value, size - edge + 1, edge))), "\n\n")
    return df.withColumn("salience", F.when(size <= most, value).otherwise(F.substring(joined, 1, most)))


def undo(files: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes back the blocks of write records (write_id, path, content_hash): (files with the texts after that, a status for each record).

    files: path, text. A block runs from its begin mark to its close mark and the newlines behind it; the newline before it
    goes too. Statuses: undone; skipped (entity stores are merged, so by hand); missing_file; missing_block; modified (the
    block's SHA-256 isn't the recorded one: it was edited and stays). Blocks of several records in a file all go.
    """
    joined = records.join(files, "path", "left")
    first, last = (mark(F.col("write_id"), m) for m in (BEGIN, CLOSE))
    start, close = F.instr("text", first), F.instr("text", last)
    tail = F.substring(F.col("text"), close + F.char_length(last), F.char_length("text"))
    newlines = F.char_length(tail) - F.char_length(F.ltrim(tail, F.lit("\n")))
    # The block's own newlines, or, if another block stands behind it, one less than there are.
    ends = [close + F.char_length(last) + n - start for n in (newlines, F.greatest(newlines - 1, F.lit(0)))]
    whole, short = (F.substring(F.col("text"), start, n) for n in ends)
    block = F.when(F.sha2(short, 256) == F.col("content_hash"), short).otherwise(whole)
    joined = joined.withColumn("block", F.when((start > 0) & (close > 0), block))
    status = F.when(F.col("text").isNull(), "missing_file").when(F.col("path").endswith("entities.json"), "skipped").when(F.col("block").isNull(), "missing_block")
    told = joined.withColumn("status", status.when(F.col("content_hash").isNotNull() & (F.sha2("block", 256) != F.col("content_hash")), "modified").otherwise("undone"))
    gone = told.filter("status = 'undone'").groupBy("path").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    cut = F.aggregate("blocks", F.col("text"), lambda s, b: F.replace(F.replace(s, F.concat(F.lit("\n"), b), F.lit("")), b, F.lit("")))
    after = files.join(gone, "path", "left").withColumn("text", F.when(F.col("blocks").isNull(), F.col("text")).otherwise(cut)).drop("blocks")
    return after, told.select("write_id", "path", "status")


def writes(items: DataFrame, todo: DataFrame, known: DataFrame, day: str, time: str, daily_path: str, todo_path: str = "todo.md", entities_path: str = "entities.json") -> DataFrame:
    """(write_id, capture_id, path, inserted_text, content_hash): what distilling the items appends to the daily note, the todo file and the entity store.

    items: write_id, capture_id, text. todo: path, text of the files as they are; known: entities (name, kind) of the store.
    No file of the vault is written, so this is the dry run too. Tasks and entities that are there already are left out, of the items
    among themselves as well: the first by capture_id has them.
    """
    rows = items.select("write_id", "capture_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tasks": tasks(F.col("text")), "people": entity_array(F.col("text"))})
    # What is made of the texts is kept in a folder, as it is read for the daily note, three times for the tasks, and for the entities.
    folder = f"{work_folder(items.sparkSession)}/distilled"
    block = daily_block(F.col("write_id"), F.lit(time), F.col("capture_id"), summary(F.col("text")), key_points(F.col("text")), F.col("people"), F.col("tasks"))
    rows.select("write_id", "capture_id", "tasks", "people", block.alias("inserted_text")).write.parquet(folder)
    rows = items.sparkSession.read.parquet(folder)
    daily = rows.select("write_id", "capture_id", F.lit(daily_path).alias("path"), "inserted_text")
    each = rows.select("write_id", "capture_id", F.posexplode("tasks").alias("ord", "t")).select("write_id", "capture_id", "ord", "t.text", "t.priority")
    once = each.groupBy("text").agg(F.min_by(F.struct("write_id", "capture_id", "ord", "priority"), F.struct("capture_id", "ord")).alias("r")).select("text", "r.*")
    fresh = new_tasks(once, todo.filter(F.col("path") == todo_path).select(F.col("text").alias("todo")))
    listed = fresh.groupBy("write_id", "capture_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "priority"))).alias("tasks"))
    tasked = listed.select("write_id", "capture_id", F.lit(todo_path).alias("path"), todo_block(F.col("write_id"), F.lit(day), F.col("tasks"), F.lit("")).alias("inserted_text"))
    found = rows.select("write_id", "capture_id", F.posexplode("people").alias("ord", "e")).select("write_id", "capture_id", "ord", "e.name", "e.kind")
    new = new_entities(found, known, ["capture_id", "ord"])
    stamp = f"{day}T{time}:00Z"
    entry = F.struct("name", "kind", F.lit(stamp).alias("first_seen_at"), F.lit(stamp).alias("last_seen_at"), F.array("capture_id").alias("source_capture_ids"), "write_id")
    stored = new.groupBy("write_id", "capture_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"])).alias("inserted_text")).select("write_id", "capture_id", F.lit(entities_path).alias("path"), "inserted_text")
    return daily.unionByName(tasked).unionByName(stored).withColumn("content_hash", F.sha2("inserted_text", 256))


def applied(files: DataFrame, made: DataFrame, header: dict[str, str] | None = None, entities_path: str = "entities.json") -> DataFrame:
    """(path, text): the files that writes() changes, with its texts behind theirs, by write_id; a new file begins with its header.

    The entity store is one JSON array: what is added joins it.
    """
    parts = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("write_id", F.col("inserted_text").alias("x")))).alias("parts"))
    rows = parts.join(files, "path", "left")
    blocks = F.transform("parts", lambda p: p["x"])
    head = reduce(lambda rest, h: F.when(F.col("path") == h[0], h[1]).otherwise(rest), (header or {}).items(), F.lit(""))
    appended = F.when(F.col("text").isNull(), F.concat(head, F.array_join(blocks, "\n"))).otherwise(F.concat(F.col("text"), F.lit("\n"), F.array_join(blocks, "\n")))
    old = F.regexp_replace(F.coalesce(F.col("text"), F.lit("[]")), r"^\s*\[|\]\s*$", "")
    added = F.array_join(F.transform(blocks, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2)), ",")
    store = F.concat(F.lit("["), F.concat_ws(",", F.nullif(F.trim(old), F.lit("")), F.nullif(added, F.lit(""))), F.lit("]"))
    return rows.select("path", F.when(F.col("path") == entities_path, store).otherwise(appended).alias("text"))


def write_records(made: DataFrame, ts: str) -> DataFrame:
    """(write_id, value): the audit record of each write as JSON, with the files that it appended to."""
    file = F.struct("path", "inserted_text", "content_hash", F.lit("append").alias("mode"))
    rows = made.groupBy("write_id", "capture_id").agg(F.array_sort(F.collect_list(file)).alias("applied_files"))
    return rows.select("write_id", F.to_json(F.struct("write_id", F.lit(ts).alias("ts"), "capture_id", "applied_files", F.lit(True).alias("can_undo"))).alias("value"))


RECORD = "write_id string, ts string, capture_id string, applied_files array<struct<path:string,inserted_text:string,content_hash:string,mode:string>>, can_undo boolean, undone_at string"


def find_records(records: DataFrame, write_ids: list[str]) -> DataFrame:
    """(write_id, path, content_hash) of the named records that can be undone, one row for each file. records: what RECORD reads."""
    rows = records.filter(F.col("write_id").isin(*write_ids) & F.col("can_undo"))
    return rows.select("write_id", F.explode("applied_files").alias("f")).select("write_id", "f.path", "f.content_hash")
