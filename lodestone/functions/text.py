"""Text expressions: tokens, phrases, excerpts, dates, titles, salience. All are Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the oracles' regular expressions have it.
SPACES = " \t\n\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value computed once, however often it stands there: a lambda's variable is."""
    return F.get(F.transform(F.array(value), of), 0)


def _folds() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters; texts of ASCII alone need no look at each letter."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), _MARKED, _PLAIN))


def tokens(text: Column) -> Column:
    """The text's tokens, runs of letters and digits of the folded text, with a blank before, between and behind them; null has none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def token_count(words: Column) -> Column:
    """Number of tokens of what tokens() gives."""
    return F.when(words == "  ", F.lit(0).cast("long")).otherwise((F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit(""))) - 1).cast("long"))


def query_tokens(query: str) -> list[str]:
    """A query's tokens by the rules of tokens(); a blank query or one of punctuation has none."""
    low = query.lower().translate(str.maketrans(_MARKED, _PLAIN))
    out, word = [], ""
    for c in low + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase stands among tokens(), overlapping ones included (a lookahead takes no blank); no phrase stands nowhere."""
    if not phrase:
        return F.lit(0).cast("long")
    return F.regexp_count(words, F.lit(f"(?= {' '.join(phrase)} )")).cast("long")


def effective_date(journal_date: Column, mtime_ns: Column) -> Column:
    """The journal date, or the UTC day of the modification time, as YYYY-MM-DD."""
    return F.coalesce(journal_date, F.date_format(F.timestamp_seconds(F.floor(mtime_ns / F.lit(1_000_000_000).cast("long"))), "yyyy-MM-dd"))


def try_date(value: Column, formats: tuple[str, ...] = ("y-M-d", "M-d-y")) -> Column:
    """The first of the formats that reads the whole value, as YYYY-MM-DD; quotes around it are dropped; else null."""
    bare = F.trim(F.regexp_replace(F.trim(value), "^[\"']|[\"']$", ""))
    return F.date_format(F.coalesce(*[F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in formats]), "yyyy-MM-dd")


def excerpt(text: Column, query: str, most: int = 400, before: int = 80, after: int = 320) -> Column:
    """Up to `most` characters around the first place of the query, or from the start; an ellipsis marks what is cut."""
    wanted = query.strip().lower()
    text = F.coalesce(text, F.lit(""))
    at = F.instr(F.lower(text), F.lit(wanted)) - 1 if wanted else F.lit(-1)
    start = F.when(at < 0, 0).otherwise(F.greatest(F.lit(0), at - before))
    room, size = max(1, most), F.char_length(text)
    end = F.least(size, start + room)
    end = F.when(at < 0, end).otherwise(F.least(F.greatest(end, F.least(size, at + len(wanted) + after)), start + room))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < size, "…").otherwise(""))
    return cut if most > 0 else F.lit("")


def note_type(rel_path: Column) -> Column:
    """journal for journal folders and files named by a date, else evergreen."""
    path = F.lower(F.replace(rel_path, F.lit("\\"), F.lit("/")))
    journal = path.rlike(r"/(20_memory/daily|journals?)/") | path.rlike(r"(^|/)\d{4}-\d{2}-\d{2}\.md$")
    return F.when(journal, "journal").otherwise("evergreen")


def file_title(rel_path: Column) -> Column:
    return F.regexp_extract(rel_path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def safe_title(title: Column, fallback: Column) -> Column:
    """Letters, digits, blanks, dashes and underscores of the title; the fallback if nothing is left."""
    kept = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N} _-]", ""))
    return F.when(kept == "", fallback).otherwise(kept)


def content_type(name: Column) -> Column:
    """Kind of a capture by its file extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    kinds = {"text": ("txt",), "markdown": ("md", "markdown"), "audio": ("mp3", "wav", "m4a", "ogg", "flac"), "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp"), "pdf": ("pdf",), "json": ("json",)}
    out = F.lit("other")
    for kind, names in kinds.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


# What makes a line salient.
SALIENT = ("i realized", "the point is", "what i'm saying", "decision", "so i'm going to", "next", "action", "summary")


def is_salient(line: Column) -> Column:
    """A question, a bullet, or one of the telling phrases."""
    bare = F.trim(line)
    low = F.lower(F.replace(bare, F.lit("’"), F.lit("'")))
    hit = bare.contains("?") | bare.rlike(r"^[-*•]")
    for phrase in SALIENT:
        hit = hit | low.contains(phrase)
    return (bare != "") & hit


# What introduces an action.
ACTION_PATTERNS = (r"need to (.+?)(?:\.|$|\n)", r"must (.+?)(?:\.|$|\n)", r"should (.+?)(?:\.|$|\n)", r"todo:?\s*(.+?)(?:\.|$|\n)", r"action:?\s*(.+?)(?:\.|$|\n)")


def actions(text: Column, most: int = 3) -> Column:
    """Distinct actions that the text names, by pattern, then place."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?id){p}"), F.lit(1)) for p in ACTION_PATTERNS]
    trimmed = F.filter(F.transform(F.concat(*found), lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "")
    return F.slice(F.array_distinct(trimmed), 1, most)


def decay(age_days: Column, half_life: float) -> Column:
    """Half for each half-life; 0 without one."""
    return F.exp(-F.log(F.lit(2.0)) * age_days / F.lit(float(half_life))) if half_life > 0 else F.lit(0.0)


def hash_share(text: Column) -> Column:
    """0 to 1 from the first four hex digits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("double") / 65535
