"""Registered queries: markdown, chunks, hashes, change detection and the upkeep of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..operators import index, markdown

_F, _L = model.with_sql("files"), model.with_sql("lines")
_FL = model.with_sql("files", "lines")


def chunk_lines_offsets(spark, d):
    return model.lines(spark, d).select("file_id", "line", "start_byte", "end_byte", "start_char", F.md5("text").alias("md5"))


def section_end_lead(spark, d):
    """Each heading's section ends where the next heading begins, the last at the end of the file."""
    files = _markdown(spark, d)
    heads = markdown.headings(markdown.parse_files(files)).join(files.select("file_id", F.octet_length("content").cast("long").alias("size")), "file_id")
    w = Window.partitionBy("file_id").orderBy("start_byte")
    return heads.select("file_id", "line", "start_byte", F.coalesce(F.lead("start_byte", 1).over(w), "size").alias("end_byte"))


def _chunks(spark, d):
    rows = model.lines(spark, d).filter("text != ''").join(model.files(spark, d).select("file_id", "rel_path", "heading_path"), "file_id")
    span = F.concat_ws(":", "rel_path", "heading_path", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"))
    rows = rows.withColumn("text_hash", F.sha2("text", 256)).withColumn("chunk_id", F.sha2(span, 256))
    return rows.withColumn("chunk_hash", F.sha2(F.concat_ws(":", F.lit("sha-16"), "chunk_id", "text_hash"), 256))


_CHUNKS = """c AS (SELECT l.*, rel_path, heading_path, sha256(l.text) AS text_hash, sha256(rel_path || ':' || heading_path || ':' || start_byte || ':' || end_byte) AS chunk_id FROM lines l JOIN files f ON f.file_id = l.file_id WHERE l.text != ''),
    chunks AS (SELECT *, sha256('sha-16:' || chunk_id || ':' || text_hash) AS chunk_hash FROM c)"""


def chunk_ids_hashes(spark, d):
    return _chunks(spark, d).select("file_id", "line", "text_hash", "chunk_id", "chunk_hash")


def headings_signature(spark, d):
    heads = markdown.headings(markdown.parse_files(_markdown(spark, d)))
    return index.ordered_digest(heads, "file_id", "ord", F.concat_ws(":", F.col("level").cast("string"), "text", F.col("start_byte").cast("string")))


def file_vector_hash(spark, d):
    return index.ordered_digest(_chunks(spark, d), "file_id", "start_byte", F.col("chunk_hash"))


def _versions(spark, d):
    """The files on disk and as they were known: some gone, some new, some touched, some changed."""
    f = model.files(spark, d).select("file_id", "rel_path", "mtime_ns", "size_bytes", "content_hash")
    disk = f.filter("file_id % 13 != 1")
    known = f.filter("file_id % 13 != 2").withColumn("mtime_ns", F.when(F.col("file_id") % 13 == 3, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))
    known = known.withColumn("size_bytes", F.when(F.col("file_id") % 13 == 4, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))).withColumn("content_hash", F.when(F.col("file_id") % 13 == 4, F.lit("old")).otherwise(F.col("content_hash")))
    return disk, known


_STATUS = "CASE file_id % 13 WHEN 1 THEN 'deleted' WHEN 2 THEN 'new' WHEN 3 THEN 'touched' WHEN 4 THEN 'changed' ELSE 'unchanged' END"


def cdc_classify(spark, d):
    return index.classify_changes(*_versions(spark, d))


def cdc_counts(spark, d):
    return index.status_counts(index.classify_changes(*_versions(spark, d)))


def cdc_touch(spark, d):
    disk, known = _versions(spark, d)
    return index.touch(known, disk, index.classify_changes(disk, known)).select("rel_path", "mtime_ns", "size_bytes", "content_hash")


def index_upsert(spark, d):
    disk, known = _versions(spark, d)
    news = disk.join(index.classify_changes(disk, known).filter("status in ('new', 'changed')"), "rel_path", "left_semi")
    return index.merge_by_key(known.select("rel_path", "content_hash"), news.select("rel_path", "content_hash"), ["rel_path"])


def tags_insert_or_ignore(spark, d):
    t = model.file_tags(spark, d).select("file_id", "name").distinct()
    return index.insert_or_ignore(t.filter("file_id % 2 = 0"), t.filter("file_id % 3 = 0"), ["file_id", "name"])


def children_replaced(spark, d):
    c = model.lines(spark, d).select("file_id", "line", F.md5("text").alias("md5"))
    parents = model.files(spark, d).filter("file_id % 5 = 0").select("file_id")
    return index.replace_children(c, c.filter("file_id % 5 = 0 and line < 2").withColumn("md5", F.lit("new")), "file_id", parents)


def cascade_delete(spark, d):
    disk, _ = _versions(spark, d)
    return index.cascade(model.outlinks(spark, d), disk.select("file_id"), "file_id")


def _stored(spark, d):
    return _chunks(spark, d).filter("line % 4 != 2").select("chunk_hash", F.lit("sha-16").alias("model"), F.lit(16).alias("dim"))


def missing_embeddings(spark, d):
    chunks = _chunks(spark, d).select("file_id", "rel_path", F.col("line").alias("ord"), "start_byte", "chunk_hash", F.lit("sha-16").alias("model"), F.lit(16).alias("dim"))
    return index.missing_embeddings(chunks, _stored(spark, d)).select("file_id", "ord", "chunk_hash")


def dangling_embeddings(spark, d):
    return index.dangling_embeddings(_stored(spark, d), _chunks(spark, d).filter("file_id % 5 != 0").select("chunk_hash")).select("chunk_hash")


def complete_files(spark, d):
    return index.complete_files(_chunks(spark, d).select("file_id", "chunk_hash"), _stored(spark, d))


def stale_fts(spark, d):
    c = _chunks(spark, d).select("file_id", "line", "chunk_id", "chunk_hash")
    indexed = c.filter("file_id % 6 != 1").withColumn("chunk_hash", F.when(F.col("file_id") % 6 == 2, F.lit("old")).otherwise(F.col("chunk_hash")))
    return index.status_counts(index.text_index_changes(c.filter("file_id % 6 != 3"), indexed).withColumnRenamed("action", "status"))


def _markdown(spark, d):
    """Each document as a note: frontmatter, every fourth line a heading, every fourth a subheading, with a link and a tag."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("# "), x)).when(i % 4 == 2, F.concat(F.lit("## "), x)).when(i % 4 == 3, F.concat(F.lit("[[Page "), i.cast("string"), F.lit("#sec|alias]] #tag"), (i % 3).cast("string"), F.lit(" "), x)).otherwise(x))
    head = F.concat(F.lit("---\ndate: 01-02-2024\ntags: [\""), "lang", F.lit("\", '#"), "source", F.lit("']\n---\n"))
    content = F.encode(F.concat(head, F.array_join(lines, "\n")), "UTF-8")
    return model.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), content.alias("content"))


_SQUEEZE = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+#+\s*$', '')"


def markdown_headings(spark, d):
    h = markdown.headings(markdown.parse_files(_markdown(spark, d)))
    return h.select("file_id", "ord", "level", F.md5("text").alias("md5"), "line", (F.col("end_byte") - F.col("start_byte")).alias("size"))


def markdown_links(spark, d):
    return markdown.outlinks(markdown.parse_files(_markdown(spark, d))).select("file_id", "ord", "target", "section", "alias", "line")


def markdown_tags(spark, d):
    return markdown.tags(markdown.parse_files(_markdown(spark, d)))


def markdown_chunks(spark, d):
    """Chunks of at most 300 bytes; each is sliced out of the file's bytes again."""
    files = _markdown(spark, d)
    c = markdown.chunk_files(files, "sha-16", 300).join(files.select("file_id", "content"), "file_id")
    same = F.sha2(F.substring("content", F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")), 256) == F.col("text_hash")
    return c.groupBy("file_id").agg(F.min("start_byte").alias("first"), F.max("end_byte").alias("last"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"), (F.max(F.col("end_byte") - F.col("start_byte")) <= 300).alias("within"), F.count_if(~same).alias("differing"))


_MD = r"""m AS (SELECT *, CASE line % 4 WHEN 0 THEN '# ' || text WHEN 2 THEN '## ' || text WHEN 3 THEN '[[Page ' || line || '#sec|alias]] #tag' || (line % 3) || ' ' || text ELSE text END AS md FROM lines)"""
#: Where each line of these notes begins: behind the frontmatter and the lines before it.
_AT = """hd AS (SELECT doc_id AS file_id, octet_length(encode(concat('---', chr(10), 'date: 01-02-2024', chr(10), 'tags: ["', lang, '", #', source, '"]', chr(10), '---', chr(10)))) + 1 AS head FROM documents),
    pos AS (SELECT m.*, (head + coalesce(sum(octet_length(encode(md)) + 1) OVER (PARTITION BY m.file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_byte,
        (head + sum(octet_length(encode(md)) + 1) OVER (PARTITION BY m.file_id) - 1)::BIGINT AS size FROM m JOIN hd ON hd.file_id = m.file_id)"""
QUERIES = {
    "chunk_lines_offsets": (chunk_lines_offsets, f"{_L} SELECT file_id, line, start_byte, end_byte, start_char, md5(text) AS md5 FROM lines"),
    "section_end_lead": (section_end_lead, f"{_L}, {_MD}, {_AT} SELECT file_id, (line + 5)::INT AS line, first_byte AS start_byte, coalesce(lead(first_byte) OVER (PARTITION BY file_id ORDER BY first_byte), size) AS end_byte FROM pos WHERE line % 2 = 0"),
    "chunk_ids_hashes": (chunk_ids_hashes, f"{_FL}, {_CHUNKS} SELECT file_id, line, text_hash, chunk_id, chunk_hash FROM chunks"),
    "headings_signature": (headings_signature, f"{_L}, {_MD}, {_AT} SELECT file_id, sha256(string_agg((CASE WHEN line % 4 = 0 THEN 1 ELSE 2 END) || ':' || {_SQUEEZE} || ':' || first_byte, '|' ORDER BY line)) AS digest FROM pos WHERE line % 2 = 0 GROUP BY file_id"),
    "file_vector_hash": (file_vector_hash, f"{_FL}, {_CHUNKS} SELECT file_id, sha256(string_agg(chunk_hash, '|' ORDER BY start_byte)) AS digest FROM chunks GROUP BY file_id"),
    "cdc_classify": (cdc_classify, f"{_F} SELECT rel_path, {_STATUS} AS status FROM files"),
    "cdc_counts": (cdc_counts, f"{_F} SELECT {_STATUS} AS status, count(*) AS n FROM files GROUP BY 1"),
    "cdc_touch": (cdc_touch, f"{_F} SELECT rel_path, mtime_ns, CASE WHEN file_id % 13 = 4 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN file_id % 13 = 4 THEN 'old' ELSE content_hash END AS content_hash FROM files WHERE file_id % 13 != 2"),
    "index_upsert": (index_upsert, f"{_F} SELECT rel_path, content_hash FROM files"),
    "tags_insert_or_ignore": (tags_insert_or_ignore, f"{model.with_sql('file_tags')} SELECT DISTINCT file_id, name FROM file_tags WHERE file_id % 2 = 0 OR file_id % 3 = 0"),
    "children_replaced": (children_replaced, f"{_L} SELECT file_id, line, CASE WHEN file_id % 5 = 0 THEN 'new' ELSE md5(text) END AS md5 FROM lines WHERE file_id % 5 != 0 OR line < 2"),
    "cascade_delete": (cascade_delete, f"{model.with_sql('outlinks')} SELECT file_id, target FROM outlinks WHERE file_id % 13 != 1"),
    "missing_embeddings": (missing_embeddings, f"{_FL}, {_CHUNKS} SELECT file_id, line AS ord, chunk_hash FROM chunks WHERE line % 4 = 2"),
    "dangling_embeddings": (dangling_embeddings, f"{_FL}, {_CHUNKS} SELECT chunk_hash FROM chunks WHERE line % 4 != 2 AND file_id % 5 = 0"),
    "complete_files": (complete_files, f"{_FL}, {_CHUNKS} SELECT file_id FROM chunks GROUP BY file_id HAVING count(*) FILTER (line % 4 = 2) = 0"),
    "stale_fts": (stale_fts, f"{_FL}, {_CHUNKS} SELECT CASE file_id % 6 WHEN 1 THEN 'insert' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' ELSE 'skip' END AS status, count(*) AS n FROM chunks GROUP BY 1"),
    "markdown_headings": (markdown_headings, f"{_L} SELECT file_id, (line // 2)::INT AS ord, (CASE WHEN line % 4 = 0 THEN 1 ELSE 2 END)::INT AS level, md5({_SQUEEZE}) AS md5, (line + 5)::INT AS line, (octet_length(encode(text)) + CASE WHEN line % 4 = 0 THEN 2 ELSE 3 END)::BIGINT AS size FROM lines WHERE line % 2 = 0"),
    "markdown_links": (markdown_links, f"{_L} SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY line) - 1)::INT AS ord, 'Page ' || line AS target, 'sec' AS section, 'alias' AS alias, (line + 5)::INT AS line FROM lines WHERE line % 4 = 3"),
    "markdown_tags": (markdown_tags, rf"""{_L}, {_MD}, h AS (SELECT file_id, unnest(regexp_extract_all(md, '(?:^|[\s(\[{{<"'':;.,!?])#([A-Za-z0-9_/-]+)', 1)) AS name FROM m)
        SELECT doc_id AS file_id, lang AS name, 'frontmatter' AS source FROM documents UNION SELECT doc_id, source, 'frontmatter' FROM documents UNION SELECT file_id, name, 'inline' FROM h"""),
    "markdown_chunks": (markdown_chunks, f"{_L}, {_MD}, {_AT} SELECT file_id, 0::BIGINT AS first, any_value(size) AS last, any_value(size) AS bytes, true AS within, 0::BIGINT AS differing FROM pos GROUP BY file_id"),
}
