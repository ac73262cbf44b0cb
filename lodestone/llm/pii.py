"""PII (operator 1): information-theoretic sanitisation.

Protected entities are the personal data that patterns find. Over the whole corpus, the documents with both a term and an
entity, those with the term and those with the entity are counted. The pointwise mutual information of term and entity, as
a share of the entity's information content, says how much of the entity the term reveals; a term that exceeds the
disclosure threshold is generalised or removed wherever it stands in a document that holds the entity. Most entities stand
in too few documents to count by themselves, so each is counted as its group too (mail domain, network, number prefix).

With N documents: PMI(t; e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, text_udf, texts, written

KINDS = ("email", "ip", "card", "phone")
#: What sanitised texts have in place of personal data and of disclosing terms.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails at its first digit fails at all its digits, so each is tried at its first only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: What a text needs for any of the patterns to match it, as the JVM's regular expression; it may hold where none does.
MAY_MATCH = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){11}|\+[0-9]"
#: Terms: words of letters, lower-cased, of four letters at least.
TERM = re.compile(r"[^\W\d_]{4,}")
#: Distinct terms a worker counts before it hands them on.
COUNTED = 150_000


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    """Is a run of digits a number of at most 255? Leading zeros may be many, so they go before it is read."""
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def span_arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds (places in KINDS) of the patterns, by start, then kind: 9 bytes a span, however dense they are."""
    starts, ends, kinds, end = array("i"), array("i"), array("b"), 0

    def add(a: int, b: int, kind: int) -> None:
        starts.append(a)
        ends.append(b)
        kinds.append(kind)

    at = text.find("@")
    floor = 0
    while at >= 0:
        lead = text[max(floor, end) : at]
        size = len(lead) - len(lead.rstrip(_LOCAL))
        floor = at + 1
        if size and (m := _DOMAIN.match(text, at)):
            end = m.end()
            add(at - size, end, 0)
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                add(m.start(), m.end(), 1)
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                add(m.start(), m.end(), 2)
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                add(m.start(), m.end(), 3)
    a, b, k = np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32), np.frombuffer(kinds, np.int8)
    order = np.lexsort((b, k, a))
    return a[order], b[order], k[order]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in KINDS."""
    a, b, k = span_arrays(text)
    return [(x, y, KINDS[z]) for x, y, z in zip(a.tolist(), b.tolist(), k.tolist(), strict=True)]


def entity(kind: str, value: str) -> str:
    """The entity that a value names: digits alone for cards and phones, lower case for addresses."""
    return f"{kind}:{''.join(_DIGITS.findall(value)) if kind in ('card', 'phone') else value.lower()}"


def group(name: str) -> str:
    """The group of an entity (see entity()): mail domain, first three parts of an address, first six digits of a card, all but the last four of a phone."""
    kind, value = name.split(":", 1)
    if kind == "email":
        return f"{kind}@{value.rsplit('@', 1)[1]}"
    return f"{kind}/{value.rsplit('.', 1)[0] if kind == 'ip' else value[:6] if kind == 'card' else value[:-4]}"


def free_terms(text: str, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of each term in the whole text that overlaps none of the spans, which are in order of start."""
    k, covered, n = 0, 0, len(starts)
    for m in TERM.finditer(text):
        while k < n and starts[k] < m.end():
            covered = max(covered, int(ends[k]))
            k += 1
        if covered <= m.start():
            yield m[0].lower(), m.start(), m.end()


_FOUND = "row long, doc_id long, digest binary, base array<struct<start:int,end:int,kind:string>>, keys array<string>, text string"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_NAMES = pa.array([*KINDS, "term"], pa.string())


def _span_lists(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """A list of spans for each row, made of whole arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a, _, _ in rows])]).astype(np.int32)
    starts, ends, kinds = (np.concatenate(c) for c in zip(*rows, strict=True))
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), _NAMES.take(pa.array(kinds, pa.int8()))], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def _span_edges(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of each row's spans, as views of the column."""
    spans = column.flatten()
    starts, ends = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
    at = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield starts[at : at + n], ends[at : at + n]
        at += n


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their patterns' spans; the entities, their groups and the text only of rows that have some."""
    row = TaskContext.get().partitionId() << 33
    for part in slices(batches):
        base, keys, digests, held = [], [], [], []
        for text in texts(part.column(1)):
            a, b, k = span_arrays(text)
            own = {entity(KINDS[z], text[x:y]) for x, y, z in zip(a, b, k, strict=True)}
            digests.append(hashlib.sha256(text.encode()).digest() if len(a) else None)
            base.append((a, b, k))
            keys.append(sorted(own | set(map(group, own))))
            held.append(text if len(a) else None)
        n = part.num_rows
        yield pa.record_batch([pa.array(range(row, row + n), pa.int64()), part.column(0), pa.array(digests, pa.binary()), _span_lists(base), pa.array(keys, pa.list_(pa.string())), pa.array(held, pa.string())], names=["row", "doc_id", "digest", "base", "keys", "text"])
        row += n
    give_back()


def _terms_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, term) for the distinct free terms of each of (row, text, base)."""
    for part in slices(batches):
        rows, found = [], []
        for row, text, (starts, ends) in zip(part.column(0).to_pylist(), texts(part.column(1)), _span_edges(part.column(2)), strict=True):
            own = {t for t, _, _ in free_terms(text, starts, ends)}
            rows += [row] * len(own)
            found += own
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(found, pa.string())], names=["row", "term"])
    give_back()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, extra) for (row, text, base, told): each free place of the told terms."""
    for part in slices(batches):
        extra = []
        for text, (starts, ends), told in zip(texts(part.column(1)), _span_edges(part.column(2)), part.column(3).to_pylist(), strict=True):
            want, a, b = set(told), array("i"), array("i")
            for t, x, y in free_terms(text, starts, ends):
                if t in want:
                    a.append(x)
                    b.append(y)
            extra.append((np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.full(len(a), len(KINDS), np.int8)))
        yield pa.record_batch([part.column(0), _span_lists(extra)], names=["row", "extra"])
    give_back()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it): combined within the task as far as its bounded memory goes."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    for part in slices(batches):
        for text in texts(part.column(0)):
            counts.update({w.lower() for w in set(TERM.findall(text))})
        if len(counts) > COUNTED:
            yield out()
            counts.clear()
    if counts:
        yield out()
        counts.clear()
    give_back()


def entity_classes(keyed: DataFrame, total: int, support: int) -> DataFrame:
    """(row, class, own): entities that stand in the same set of rows as one class, own being the number of these rows.

    keyed: row, key, each pair once. Entities in fewer than `support` rows, or in all, are left out. Sets are told apart by
    hashes; as the rows of each class are counted then, two sets that share one are found, and other hashes taken.
    """
    for seed in range(16):
        hashes = [F.bit_xor(F.xxhash64("row", F.lit(1000 * k + seed))).alias(f"h{k}") for k in (0, 1)]
        owners = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("own"), *hashes).filter((F.col("own") >= support) & (F.col("own") < total))
        found = written(keyed.join(owners.select("key", "own", F.xxhash64("own", "h0", "h1").alias("class")), "key").select("row", "class", "own").distinct(), "classes")
        if found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).filter("n != own").isEmpty():
            return found
    raise RuntimeError("hashes of sets of rows collide")


#: Entities of a row beyond which its terms are dealt out: a task makes at most so many pairs for each of the row's terms.
ROW_ENTITIES = 64


def row_pairs(terms: DataFrame, entities: DataFrame, most: int = ROW_ENTITIES) -> DataFrame:
    """Each term (row, term, n) with each class of entities (row, class, own) of its row; a row of more than `most` classes is dealt out, by term, to a task for each `most` of them."""
    parts = entities.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    left = terms.join(parts, "row").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).drop("parts")
    right = entities.join(parts, "row").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(right, ["row", "part"])


def disclosing_terms(found: DataFrame, df: DataFrame, text_col: str = "text", threshold: float = 0.8, share: float = 0.25, support: int = 3) -> DataFrame:
    """(row, term) of the terms that reveal an entity or a group of entities of the row: PMI / IC of threshold or more, found in at least `share` of its documents and `support` of them.

    found: row, keys, text and base of the rows. An entity in all documents has no information to reveal. Entities and
    terms in fewer than `support` documents, and terms in more than N (n(e) / N) ** threshold, can't pass: they are left out
    before pairs are made, which changes no result. Entities that stand in the same rows have the same counts, so pairs
    are made with one for each set of rows: copies of a long list of people cost as much as copies with one.
    """
    total = df.count()
    entities = entity_classes(found.filter(F.size("keys") > 0).select("row", F.explode("keys").alias("key")), total, support)
    terms = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    rows = found.join(entities.select("row").distinct(), "row", "left_semi").select("row", "text", "base")
    known = rows.mapInArrow(_terms_of_rows, "row long, term string").join(terms, "term")
    most = F.lit(float(total)) * F.pow(F.col("own") / F.lit(float(total)), F.lit(threshold))
    pairs = written(row_pairs(known, entities).filter(F.col("n") <= most * 1.000001).select("row", "class", "own", "term", "n"), "pairs")
    both = pairs.groupBy("class", "term").agg(F.count(F.lit(1)).alias("both"), F.first("own").alias("own"), F.first("n").alias("n"))
    ratio = F.log(F.lit(float(total)) * F.col("both") / (F.col("n") * F.col("own"))) / F.log(F.lit(float(total)) / F.col("own"))
    telling = both.filter((F.col("both") >= support) & (F.col("both") >= share * F.col("own")) & (ratio >= threshold))
    return pairs.join(telling.select("class", "term"), ["class", "term"]).select("row", "term").distinct()


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, share: float = 0.25, support: int = 3) -> DataFrame:
    """doc_id, digest, base, extra for each row of df: spans (start, end, kind) in code points, end exclusive.

    base has the patterns' spans by start, then kind; extra every place of the terms that disclose one of the row's
    entities or their groups, by start. digest is the text's SHA-256, null where base is empty. A null text is an empty
    one. Repeated rows and rows of null id are rows and count as documents of their own. Counts cover all rows and whole
    texts. No rows give no rows.
    """
    small_batches(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(own.mapInArrow(_detect, _FOUND), "found")
    told = disclosing_terms(found, own, "text", threshold, share, support).groupBy("row").agg(F.collect_set("term").alias("told"))
    extra = found.join(told, "row").select("row", "text", "base", "told").mapInArrow(_places, "row long, extra array<struct<start:int,end:int,kind:string>>")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return found.select("row", "doc_id", "digest", "base").join(extra, "row", "left").select("doc_id", "digest", "base", F.coalesce("extra", empty).alias("extra"))


def _told(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(df: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms: the spans of find_pii() as counts and strings."""
    found = find_pii(df, **how)
    kinds = F.array(*map(F.lit, (*KINDS, "term")))
    both = F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(both).alias("spans"), F.size("extra").cast("long").alias("n_terms"))


def mask(text: str, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, generalise: bool = True) -> str:
    """The text with each span's mask in its place; of overlapping spans the first and longest is masked, and all they cover goes.

    kinds are places in KINDS, behind them that of a term.
    """
    out, at = [], 0
    marks = [MARKS[k] for k in KINDS] + [MARKS["term"] if generalise else ""]
    order = np.lexsort((-ends, starts))
    for start, end, kind in zip(starts[order].tolist(), ends[order].tolist(), kinds[order].tolist(), strict=True):
        if start >= at:
            out += [text[at:start], marks[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: bool = True, **how) -> DataFrame:
    """df with personal data masked and disclosing terms generalised (or removed): same rows, same columns; a null text stays null.

    Spans meet their rows by id and text digest; rows that repeat both have the same spans.
    Texts that none of the patterns can match pass by: only the others are shuffled to their spans.
    """
    def make():
        return lambda text, starts, ends, kinds: [t if a is None else mask(t, np.asarray(a), np.asarray(b), np.asarray(k), generalise) for t, a, b, k in zip(text, starts, ends, kinds, strict=True)]

    masked = text_udf("string", make)
    edits = find_pii(df, id_col, text_col, **how).filter("digest is not null")
    edits = edits.groupBy(F.col("doc_id").alias("__lodestone_id"), F.col("digest").alias("__lodestone_digest")).agg(F.any_value(F.concat("base", "extra")).alias("__lodestone_spans"))
    edits = written(edits, "edits")
    may = F.coalesce(F.col(text_col).cast("string").rlike(MAY_MATCH), F.lit(False))
    keyed = df.filter(may).withColumn("__lodestone_text", F.unhex(F.sha2(F.col(text_col).cast("string"), 256)))
    joined = keyed.join(edits, keyed[id_col].cast("long").eqNullSafe(F.col("__lodestone_id")) & (F.col("__lodestone_text") == F.col("__lodestone_digest")), "left")
    spans = F.col("__lodestone_spans")
    parts = [F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]), F.transform(spans, lambda s: (F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"]) - 1).cast("int"))]
    done = joined.select(*[masked(F.col(c).cast("string"), *parts).alias(c) if c == text_col else keyed[c] for c in df.columns])
    return df.filter(~may).withColumn(text_col, F.col(text_col).cast("string")).select(*df.columns).unionByName(done)
