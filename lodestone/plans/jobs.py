"""Whole jobs, put together of the operators: asking, indexing a folder of notes, ingesting conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.text import excerpt, safe_title
from ..functions.vectors import hash_embed, hash_embedding
from ..operators import ask, classify, conversations, index, ledger, markdown, review, search
from ..operators import notes as note_texts
from ..operators.segments import SegmentedIndex
from ..operators.textindex import TextIndex
from ..sources import appends, logs, vault
from ..sources.logs import MANIFEST, read_jsonl


def with_snapshot(settings: dict, snapshot: dict | None) -> dict:
    """settings with a session's numbers for top_k, per_file_cap and packed_max_chars where these can be read."""
    out = dict(settings)
    for k, v in (snapshot or {}).items():
        if k in ("top_k", "per_file_cap", "packed_max_chars"):
            try:
                out[k] = int(v)
            except (TypeError, ValueError):
                continue
    return out


HIT = ["file_id", "rel_path", "title", "heading_path", "start_byte", "end_byte", "effective_date", "mtime_ns", "score", "expanded_context", "excerpt", "part"]


def gather(chunks: DataFrame, files: DataFrame, vectors: DataFrame, outlinks: DataFrame, query: str, vector: list[float], pinned: DataFrame | None = None, top_k: int = 10, expand: int = 10, file_key: str = "file_id", text_index: TextIndex | None = None) -> DataFrame:
    """The hits of a question: those of the hybrid search, the newest neighbours of their files, a session's pins; part says which."""
    primary = search.hybrid(chunks, vectors, query, vector, top_k, index=text_index)
    hits = primary.withColumn("expanded_context", F.lit(False)).withColumn("part", F.lit(0)).select(HIT)
    near = search.expand_links(primary.select(F.col(file_key).alias("file_id"), "title").distinct(), files, outlinks, expand)
    near = near.withColumn("excerpt", excerpt(F.col("text"), query)).withColumn("part", F.lit(1))
    hits = hits.unionByName(near.select(HIT))
    if pinned is not None:
        kept = search.dated(ask.pins(chunks, pinned)).withColumns({"score": F.lit(0.0), "expanded_context": F.lit(False), "excerpt": excerpt(F.col("text"), query), "part": F.lit(2)})
        hits = hits.unionByName(kept.select(HIT))
    return hits


def ask_plan(*tables, mode: str = "hybrid", per_file_cap: int = 3, packed_max_chars: int = 8000, **how) -> DataFrame:
    """The packed excerpts of a question, by rank: what gather() finds in temporal order, deduped and capped, within the budget.

    tables and how: see gather(). chunks: one or more for each file, with start_byte and end_byte, their file named by
    file_key; files: one row each. What follows the search has top_k + expand + pinned rows; a session keeps few pins.
    """
    return ask.pack(ask.rerank(ask.temporal(gather(*tables, **how), mode), per_file_cap), packed_max_chars)


TABLES = {
    "files": "rel_path string, title string, mtime_ns long, size_bytes long, content_hash string, fm_journal_date string, plan_hash string, made int",
    "chunks": "rel_path string, ord int, heading_path string, start_byte long, end_byte long, text string, chunk_id string, chunk_hash string, vector array<double>",
    "outlinks": "rel_path string, ord int, target string",
    "tags": "rel_path string, name string, source string",
}


def _state(spark: SparkSession, store: str) -> tuple[int, int]:
    """The number of the run whose tables are in force and the generation of the text index that goes with it; zeros without any."""
    pointer = f"{store}/current"
    if not storage.exists(spark, pointer):
        return 0, 0
    parts = F.split("value", ":")
    last = spark.read.text(pointer).select(parts[0].cast("int").alias("run"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)).alias("text")).agg(F.max(F.struct("run", "text")).alias("m")).first().m
    return (last.run, last.text) if last else (0, 0)


def _put_in_force(spark: SparkSession, store: str, run: int, text: int) -> None:
    spark.createDataFrame([(f"{run}:{text}",)], "value string").coalesce(1).write.mode("append").text(f"{store}/current")


def vault_tables(spark: SparkSession, store: str, state: int | None = None) -> dict[str, DataFrame]:
    """The tables of index_vault(): files, and of the others the rows that the run wrote which last parsed their file."""
    state = _state(spark, store)[0] if state is None else state
    if not state:
        return {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
    files = spark.read.schema(TABLES["files"]).parquet(f"{store}/files/state={state}")
    live = files.select("rel_path", "made")
    rest = {t: spark.read.schema(f"{s}, made int").option("basePath", f"{store}/{t}").parquet(f"{store}/{t}").join(live, ["rel_path", "made"], "left_semi").drop("made") for t, s in TABLES.items() if t != "files"}
    return {"files": files, **rest}


def index_vault(spark: SparkSession, root: str, store: str, model: str = "sha-16", dim: int = 16, most: int = 4000, exclude: list[str] | None = None, full: bool = False, strategy: str = "paragraph_then_window", segments: int = 8) -> dict[str, int]:
    """Brings the tables and the text index under `store` up to date with the notes under `root` and returns how many files are in each state.

    Files are read once, into a table of the run that holds the content of those to be parsed: a file is parsed, chunked and
    embedded again if its content or the settings have changed (its plan's hash says so). Such files alone are written,
    behind what is there, as one more segment of the text index too (see SegmentedIndex; of more than `segments`, small ones
    are merged); only the list of files is written whole, and it says which run's rows of a file are in force. A pointer
    names list and index last, so a job that breaks off leaves the old state in force, and a run after it writes its own
    rows anew. full: everything is built again and what earlier runs wrote is deleted.
    """
    if strategy not in markdown.STRATEGIES:
        raise ValueError(f"no strategy {strategy}; there are {', '.join(markdown.STRATEGIES)}")
    state, text = _state(spark, store)
    now, settings = state + 1, {"model": model, "dim": dim, "most": most, "strategy": strategy}
    full = full or not text  # a store without a text index gets one
    old = vault_tables(spark, store, 0 if full else state)["files"]
    plan = index.plan_hash(F.col("content_hash"), F.lit(""), settings)
    planned = vault.read_vault(spark, root, exclude).withColumn("plan_hash", plan).join(old.select("rel_path", F.col("plan_hash").alias("__old")), "rel_path", "left")
    stale = ~F.col("plan_hash").eqNullSafe(F.col("__old"))
    planned.withColumns({"stale": stale, "content": F.when(stale, F.col("content"))}).drop("__old").write.mode("overwrite").parquet(f"{store}/work/disk")
    disk = spark.read.parquet(f"{store}/work/disk")
    changes = index.classify_changes(disk, old)
    work = disk.filter("stale").withColumn("file_id", F.lit(0).cast("long"))
    markdown.parse_files(work).write.mode("overwrite").parquet(f"{store}/work/parsed")
    parsed = spark.read.parquet(f"{store}/work/parsed")
    fresh = work.join(parsed.select("rel_path", F.col("journal_date").alias("fm_journal_date")), "rel_path").withColumn("made", F.lit(now))
    made = {
        "chunks": markdown.chunk_files(work, model, most, strategy=strategy).withColumn("vector", hash_embedding(F.col("text"), dim)).sortWithinPartitions("rel_path", "ord"),
        "outlinks": parsed.select("rel_path", F.explode("outlinks").alias("l")).select("rel_path", "l.ord", "l.target"),
        "tags": parsed.select("rel_path", F.explode("fm_tags").alias("name"), F.lit("frontmatter").alias("source")).unionByName(parsed.select("rel_path", F.explode("inline_tags").alias("name"), F.lit("inline").alias("source"))).distinct(),
    }
    for t, rows in made.items():
        columns = [c.split()[0] for c in TABLES[t].split(", ")]
        rows.select(columns).write.mode("overwrite").parquet(f"{store}/{t}/made={now}")
    kept = index.touch(old.join(changes.filter("status != 'deleted'"), "rel_path", "left_semi"), disk, changes)
    listed = kept.join(fresh.select("rel_path"), "rel_path", "left_anti").unionByName(fresh.select(old.columns))
    listed.write.mode("overwrite").parquet(f"{store}/files/state={now}")
    counts = {r.status: r.n for r in index.status_counts(changes).collect()}
    chunks = spark.read.schema(TABLES["chunks"]).parquet(f"{store}/chunks/made={now}").join(fresh.select("rel_path", "mtime_ns"), "rel_path")
    emptied = changes.filter("status = 'deleted'").select("rel_path").unionByName(fresh.select("rel_path"))
    touched = disk.join(changes.filter("status = 'touched'"), "rel_path", "left_semi").select("rel_path", "mtime_ns")
    words = SegmentedIndex(spark, f"{store}/text", segments)
    words.add(chunks.withColumn("file_id", F.col("chunk_id")), emptied, touched, after=0 if full else text)
    text = words.merge().number
    _put_in_force(spark, store, now, text)
    storage.drop(spark, f"{store}/files/state={state - 1}")  # the list before stays for readers that have begun
    storage.drop(spark, f"{store}/work")
    _sweep(spark, store, [now] if full else [state, now])
    if full:
        for k in range(1, now):
            for t in made:
                storage.drop(spark, f"{store}/{t}/made={k}")
    return counts


def _sweep(spark: SparkSession, store: str, states: list[int]) -> None:
    """Deletes the folders of runs that none of the lists of files names."""
    lists = [spark.read.schema(TABLES["files"]).parquet(f"{store}/files/state={k}") for k in states if storage.exists(spark, f"{store}/files/state={k}")]
    named = {r.made for df in lists for r in df.select("made").distinct().collect()}
    for t in TABLES:
        for name in storage.names(spark, f"{store}/{t}") if t != "files" else ():
            made = name.removeprefix("made=")
            if made != name and int(made) <= max(states) and int(made) not in named:
                storage.drop(spark, f"{store}/{t}/{name}")


def compact_vault(spark: SparkSession, store: str, most_runs: int = 16) -> list[int]:
    """Puts the rows in force of runs of which less than half still count into one new run, or those of all runs but the largest if there are more than `most_runs`; returns the runs.

    Only the rows of these runs are read and written. The new list of files is named last, as in index_vault(); the list
    before and the rows it names stay for readers that have begun, what neither of the two names is deleted.
    """
    run, text = _state(spark, store)
    tables = vault_tables(spark, store, run)
    stored = {r.made: r.n for r in spark.read.option("basePath", f"{store}/chunks").parquet(f"{store}/chunks").groupBy("made").agg(F.count(F.lit(1)).alias("n")).collect()} if run else {}
    counted = {r.made: r.n for r in tables["chunks"].join(tables["files"].select("rel_path", "made"), "rel_path").groupBy("made").agg(F.count(F.lit(1)).alias("n")).collect()} if run else {}
    runs = [m for m, in tables["files"].select("made").distinct().collect()]
    picked = [m for m in runs if 2 * counted.get(m, 0) < stored.get(m, 0)]
    if len(runs) > most_runs:
        picked = sorted(set(picked) | set(sorted(runs, key=lambda m: stored.get(m, 0))[:-1]))
    if not picked:
        return []
    now = run + 1
    own = tables["files"].filter(F.col("made").isin(picked)).select("rel_path")
    for t, schema in TABLES.items():
        if t != "files":
            columns = [c.split()[0] for c in schema.split(", ")]
            rows = tables[t].join(own, "rel_path", "left_semi").select(columns)
            (rows.sortWithinPartitions("rel_path", "ord") if "ord" in columns else rows).write.mode("overwrite").parquet(f"{store}/{t}/made={now}")
    moved = tables["files"].withColumn("made", F.when(F.col("made").isin(picked), now).otherwise(F.col("made")).cast("int"))
    moved.write.mode("overwrite").parquet(f"{store}/files/state={now}")
    _put_in_force(spark, store, now, text)
    _sweep(spark, store, [run, now])
    storage.drop(spark, f"{store}/files/state={run - 1}")
    return picked


def vault_hits(spark: SparkSession, store: str, query: str, dim: int = 16, top_k: int = 10, expand: int = 10) -> DataFrame:
    """The hits of a question, top_k + expand rows at most, found without reading a text: by the text index, the vectors and the links."""
    run, text = _state(spark, store)
    t = vault_tables(spark, store, run)
    files = t["files"]
    chunks = t["chunks"].drop("text").join(files.select("rel_path", "title", "mtime_ns", "fm_journal_date"), "rel_path").withColumn("file_id", F.col("chunk_id"))
    words = SegmentedIndex(spark, f"{store}/text").index(text) if text else None
    primary = search.hybrid(chunks, chunks.select("file_id", "vector"), query, hash_embed(query, dim), top_k, index=words)
    seeds = primary.select(F.col("rel_path").alias("file_id"), "title").distinct()
    near = search.expand_links(seeds, files.withColumn("file_id", F.col("rel_path")), t["outlinks"].select(F.col("rel_path").alias("file_id"), "target"), expand)
    place = F.min_by(F.struct("heading_path", "start_byte", "end_byte"), F.struct("ord", "start_byte")).alias("p")
    first = t["chunks"].join(F.broadcast(near.select("rel_path")), "rel_path", "left_semi").groupBy("rel_path").agg(place).select("rel_path", "p.*")  # `expand` rows
    columns = [c for c in HIT if c != "excerpt"]
    hits = primary.withColumns({"expanded_context": F.lit(False), "part": F.lit(0)}).select(columns)
    return hits.unionByName(near.join(first, "rel_path").withColumn("part", F.lit(1)).select(columns))


def ask_vault(spark: SparkSession, store: str, query: str, dim: int = 16, top_k: int = 10, expand: int = 10, mode: str = "hybrid", per_file_cap: int = 3, packed_max_chars: int = 8000) -> DataFrame:
    """One row, answer, over the tables of index_vault(). Texts are read for the hits alone, by their files' paths."""
    hits = vault_hits(spark, store, query, dim, top_k, expand)
    found = hits.collect()  # top_k + expand rows
    chunks = vault_tables(spark, store)["chunks"].filter(F.col("rel_path").isin(sorted({r.rel_path for r in found}) or [""]))
    texts = chunks.select("rel_path", "start_byte", "end_byte", excerpt(F.col("text"), query).alias("excerpt")).dropDuplicates(["rel_path", "start_byte", "end_byte"])
    rows = spark.createDataFrame(found, hits.schema).join(texts, ["rel_path", "start_byte", "end_byte"]).select(HIT)
    return ask.answer(ask.pack(ask.rerank(ask.temporal(rows, mode), per_file_cap), packed_max_chars), query)


def apply_writes(made: DataFrame, root: str, headers: dict[str, str] | None = None, entities_path: str = "entities.json") -> DataFrame:
    """Appends what distill.writes() gives to the files under root, by write_id, with the bytes of distill.applied(); returns what was written where.

    No file is read whole and no file's blocks meet in one task: see append_texts(). take_back() undoes blocks by their place.
    """
    inner = F.expr("substring(inserted_text, 2, char_length(inserted_text) - 2)")
    blocks = made.select("path", "write_id", F.when(F.col("path") == entities_path, inner).otherwise(F.col("inserted_text")).alias("text"))
    return appends.append_texts(blocks.filter("text != ''"), root, ["write_id"], headers=headers, arrays=(entities_path,))


def apply_review(made: DataFrame, root: str) -> DataFrame:
    """Writes what review.dispatch() gives under root, with the texts of review.files_after(): appended by proposal_id, or whole files, of several for one path the last; returns what was appended where."""
    whole = made.filter("mode = 'create'").groupBy("path").agg(F.max_by("text", "proposal_id").alias("text"))
    vault.write_texts(whole, root)
    return appends.append_texts(made.filter("mode = 'append'"), root, ["proposal_id"], separator="", headers="header", arrays=(review.ENTITIES,), comma=", ")


class InjectedCrash(RuntimeError):
    """Raised by sync_transcripts() on request, between two days."""


def sync_transcripts(spark: SparkSession, talks: DataFrame, root: str, manifest: str, run_id: str, ts: str, crash_after: int | None = None) -> dict[str, int]:
    """Writes the segments of transcripts (see sources.transcripts) that the notes under root don't have yet, and one manifest line.

    Returns segments written and skipped, days and conversations. What is written is told by the notes' own segment ids, so
    a run after a crash, or a second run, writes each segment exactly once. Days are written in order, each whole; with
    crash_after, the run breaks off once so many segments are done. The manifest's last timestamp is that of the last
    conversation of a finished run, so resume_from() never skips what a crash left out.
    """
    notes = vault.read_vault(spark, root).select(F.col("rel_path").alias("path"), F.decode("content", "UTF-8").alias("text"))
    segments = talks.select(F.date_format("started_at", "yyyy-MM-dd").alias("day"), F.explode("segments.segment_id").alias("segment_id")).cache()
    days = [r.day for r in segments.select("day").distinct().orderBy("day").collect()]
    groups = [[d] for d in days] if crash_after is not None else [days] if days else []
    total = segments.select("segment_id").distinct().count()
    written = done = 0
    for group in groups:
        known = conversations.written_segments(notes)
        new = write_days(notes, talks.filter(F.date_format("started_at", "yyyy-MM-dd").isin(group)), known).cache()
        written += new.agg(F.coalesce(F.sum("segments"), F.lit(0)).alias("n")).first().n
        vault.write_texts(new, root)
        new.unpersist()
        done += segments.filter(F.col("day").isin(group)).count()
        if crash_after is not None and done >= crash_after:
            raise InjectedCrash(f"after {done} segments")
    out = {"segments_written": written, "segments_skipped": total - written, "days": len(days), "conversations": talks.count()}
    last = talks.agg(F.date_format(F.max("finished_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last"))
    counts = F.struct(F.lit(out["conversations"]).alias("discovered"), F.lit(written).alias("ingested"), F.lit(total - written).alias("skipped"), F.lit(0).alias("errored"))
    record = last.select(F.lit(1).alias("schema_version"), F.lit("transcripts").alias("source"), F.lit(run_id).alias("run_id"), counts.alias("counts"), F.col("last").alias("last_successful_item_timestamp"), F.lit(ts).alias("created_at"))
    record.coalesce(1).write.mode("append").json(manifest)
    segments.unpersist()
    return out


def write_days(notes: DataFrame, talks: DataFrame, known: DataFrame) -> DataFrame:
    """(path, text, segments): the day notes with what they get of new segments; a new note begins with a heading."""
    new = note_texts.transcript_notes(talks, known).select(F.concat(F.lit("transcripts/"), "day", F.lit(".md")).alias("path"), "day", F.col("text").alias("more"), "segments")
    rows = new.join(notes, "path", "left")
    return rows.select("path", F.concat(F.coalesce("text", F.concat(F.lit("# Transcripts "), "day", F.lit("\n"))), "more").alias("text"), "segments")


def resume_from(spark: SparkSession, manifest: str, source: str) -> str | None:
    """The last timestamp that the latest run of a source recorded; null without one."""
    if not storage.exists(spark, manifest):
        return None
    rows = read_jsonl(spark, manifest, MANIFEST, ["source", "run_id", "created_at"]).filter(F.col("source") == source)
    return rows.agg(F.max("last_successful_item_timestamp").alias("t")).first().t


def backfill_metadata(spark: SparkSession, root: str, answers: Callable[[DataFrame], DataFrame], version: int, log: str, run_id: str, limit: int | None = None, batch: int = 1_000, dry_run: bool = False) -> dict[str, int]:
    """Generates the metadata that notes under root lack: in order of their paths, at most `limit` notes, `batch` at a time, with a progress event for each.

    Notes are read once, into a table in order of their paths; each batch reads its own part of it. answers gives (path,
    text) a column answer, as a model would; only notes that want one are asked about. A batch's notes
    are written before its event, and notes that are up to date are passed over, so a broken run is simply repeated.
    Returns how many notes have each status.
    """
    work = storage.work_folder(spark)
    notes = vault.read_vault(spark, root).select(F.col("rel_path").alias("path"), F.decode("content", "UTF-8").alias("text"))
    dealt = notes.repartitionByRange("path").sortWithinPartitions("path").withColumn("__p", F.spark_partition_id())
    dealt.write.parquet(f"{work}/notes")
    rows = spark.read.parquet(f"{work}/notes")
    before = F.coalesce(F.sum("m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("m")).withColumn("before", before).select("__p", "before")  # a row for each task
    numbered = rows.join(F.broadcast(places), "__p").withColumn("n", F.row_number().over(Window.partitionBy("__p").orderBy("path")) + F.col("before") - 1)
    numbered = numbered.filter(F.col("n") < limit) if limit is not None else numbered
    numbered.select("path", "text", F.expr(f"cast(n div {batch} as int)").alias("part")).write.partitionBy("part").parquet(f"{work}/parts")
    parts = spark.read.schema("path string, text string, part int").parquet(f"{work}/parts")
    total = parts.count()
    counts: dict[str, int] = {}

    def tell(status: str, done: int) -> None:
        payload = F.create_map(*[F.lit(x) for x in ("status", status, "processed", str(done), "total", str(total))])
        logs.append_events(spark.range(1).select(F.lit("METADATA_BACKFILL_PROGRESS").alias("event_type"), F.lit(None).cast("string").alias("capture_id"), payload.alias("payload")), log, run_id)

    tell("started", 0)
    for at in range(0, total, batch):
        own = parts.filter(F.col("part") == at // batch).drop("part")
        waiting = note_texts.metadata_workflow(own.withColumn("answer", F.lit(None).cast("string")), version, dry_run=dry_run).filter("status = 'waiting'").select("path")
        asked = answers(own.join(waiting, "path", "left_semi")).select("path", "answer")
        made = note_texts.metadata_workflow(own.join(asked, "path", "left"), version, dry_run=dry_run).cache()
        for r in made.groupBy("status").count().collect():
            counts[r.status] = counts.get(r.status, 0) + r["count"]
        vault.write_texts(made.filter("status = 'generated'"), root)
        made.unpersist()
        tell("running", min(at + batch, total))
    tell("completed", total)
    storage.drop(spark, work)
    return counts


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, destination, note_path) of a state file, a JSON object by conversation; a file that is missing or broken has none, an entry without destination or path is left out."""
    schema = "conversation_id string, destination string, note_path string"
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    entries = "map<string,struct<destination_vault:string,output_note_relpath:string>>"
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(F.expr(f"try_variant_get(try_parse_json(value), '$.conversations', '{entries}')")))
    return rows.select(F.col("key").alias("conversation_id"), F.col("value.destination_vault").alias("destination"), F.col("value.output_note_relpath").alias("note_path")).filter("destination != '' and note_path != ''")


def ingest_exports(spark: SparkSession, raw: DataFrame, root: str, state: str, reclassify: bool = False) -> dict[str, int]:
    """Writes normalised conversations as notes under root by destination, then the state: (conversation_id, destination, note_path) as JSON lines under `state`.

    A conversation keeps the destination and path that the state has for it, unless all are classified again; new ones of
    one title in one folder get suffixes that no other has. Notes whose content hash stands in the note already are not
    written again. Notes come first and the state is swapped in last, so a broken run is repeated without harm.
    """
    if not storage.exists(spark, state) and storage.exists(spark, f"{state}.new/_SUCCESS"):
        storage.rename(spark, f"{state}.new", state)  # a run broke off between the two steps of the swap
    known = spark.read.schema("conversation_id string, destination string, note_path string").json(state) if storage.exists(spark, state) else spark.createDataFrame([], "conversation_id string, destination string, note_path string")
    turns = raw.select(F.col("conversation_id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", "m.role", "m.content")
    titled = conversations.conversation_rows(turns).drop("title").join(raw.select(F.col("conversation_id").alias("conv_id"), "title").dropDuplicates(["conv_id"]), "conv_id")
    placed = classify.sticky(classify.destination(titled).select("conv_id", "destination"), known.withColumnRenamed("conversation_id", "conv_id"), reclassify).select("conv_id", "destination")
    rows = ingest_conversations(raw.dropDuplicates(["conversation_id"]), spark.createDataFrame([], "conversation_id string, content_hash string"))
    rows = rows.join(placed.withColumnRenamed("conv_id", "conversation_id"), "conversation_id", "left").withColumn("destination", F.coalesce("destination", F.lit("daemon")))
    rows = rows.join(known.select("conversation_id", F.col("destination").alias("__was"), "note_path"), "conversation_id", "left")
    folder = F.concat("destination", F.lit("/"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("undated")))
    old = rows.filter("note_path is not null and __was = destination").withColumn("path", F.col("note_path"))
    new = rows.filter("note_path is null or __was != destination").withColumns({"__base": F.concat(folder, F.lit("/"), safe_title(F.col("title"), F.lit("Untitled"))), "__ext": F.lit(".md")})
    there = vault.read_vault(spark, root).select(F.col("rel_path").alias("path"), note_texts.scalar_fields(note_texts.frontmatter(F.decode("content", "UTF-8")))["content_hash"].alias("__hash")) if storage.exists(spark, root) else spark.createDataFrame([], "path string, __hash string")
    taken = known.select(F.col("note_path").alias("file_name")).union(there.select("path"))
    named = ledger.free_names(new, "__base", "__ext", taken, ["created_at", "conversation_id"]).withColumn("path", F.col("file_name"))
    columns = ["conversation_id", "destination", "path", "text", "content_hash"]
    notes = old.select(columns).unionByName(named.select(columns))
    notes = notes.join(there, "path", "left").cache()
    total, fresh = notes.count(), notes.filter(~F.col("content_hash").eqNullSafe(F.col("__hash")))
    written = vault.write_texts(fresh, root) if total else 0
    after = known.join(notes.select("conversation_id"), "conversation_id", "left_anti").unionByName(notes.select("conversation_id", "destination", F.col("path").alias("note_path")))
    after.write.mode("overwrite").json(f"{state}.new")
    storage.drop(spark, state)
    storage.rename(spark, f"{state}.new", state)
    notes.unpersist()
    return {"conversations": total, "written": written, "unchanged": total - written}


def ingest_conversations(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes to write of normalised conversations: those whose content hash isn't the stored one. stored: conversation_id, content_hash."""
    body = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"], F.coalesce(m["created_at"].cast("string"), F.lit("")))), "|")
    rows = raw.withColumn("content_hash", F.sha2(F.concat_ws("|", "conversation_id", "title", F.coalesce(F.col("created_at").cast("string"), F.lit("")), F.coalesce(F.col("updated_at").cast("string"), F.lit("")), body), 256))
    fresh = conversations.changed_notes(rows.withColumnRenamed("conversation_id", "conv_id"), stored.withColumnRenamed("conversation_id", "conv_id")).withColumnRenamed("conv_id", "conversation_id")
    text = F.concat(F.lit("---\nconversation_id: "), "conversation_id", F.lit("\ncontent_hash: "), "content_hash", F.lit("\n---\n# "), "title", F.lit("\n\n## Transcript\n\n"), F.array_join(F.transform("messages", lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit(":** "), m["content"])), "\n\n"), F.lit("\n"))
    return fresh.withColumn("text", text)
