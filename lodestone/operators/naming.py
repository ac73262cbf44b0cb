"""Names that no one else has: of name, name_1, name_2, ... each item gets the first that is free, as if items came one by one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import row_numbers

#: Items of one name that share a row of the table which says how their numbers are shifted.
PIECE = 1024
_RESOLVED = "__base string, __ext string, __piece long, __shifts array<struct<k:long,shift:long>>, __child string"


def _parts(whole: Column) -> dict[str, Column]:
    """A whole name as base and extension: a number goes before the last dot of the last part of a path."""
    extension = F.regexp_extract(whole, r"[^/](\.[^./]+)$", 1)
    return {"__ext": extension, "__base": F.substring(whole, F.lit(1), F.length(whole) - F.length(extension))}


def _numbered(df: DataFrame, separator: str, first: int) -> DataFrame:
    """The rows whose base is another's with a number: __parent, and __j, from 1, that says which name of the parent's it is."""
    pattern = rf"(?s)^(.*){re.escape(separator)}([1-9][0-9]{{0,15}})$"
    rows = df.withColumns({"__parent": F.regexp_extract("__base", pattern, 1), "__j": F.nullif(F.regexp_extract("__base", pattern, 2), F.lit("")).cast("long") - (first - 1)})
    return rows.filter("__j >= 1")


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """How far the numbers of a base's items are shifted, from which item on, and which other bases lose their own name to one of its items.

    Rows: names lo to hi that stand already (child is null), or name lo that items of another base want, of which the first
    comes after `before` of this base's items. Items take names in turn, so the item at a name is known from how many were passed.
    """
    most = int(frame["m"].iloc[0])
    passed, last = 0, -1
    shifts, lost = [(0, 0)], []
    for lo, hi, before, child in sorted(zip(frame["lo"].tolist(), frame["hi"].tolist(), frame["before"].tolist(), frame["child"].tolist(), strict=True), key=lambda r: (r[0], r[3] is not None)):
        turn = int(lo) - passed
        if turn >= most:
            break
        if lo <= last:
            lo = last + 1
            if lo > hi:
                continue
            turn = int(lo) - passed
        last = int(hi)
        if child is not None and turn < before:
            lost.append(child)
            continue
        passed += int(hi - lo) + 1
        shifts.append((turn, passed))
    out, at, shift = [], 0, 0
    if passed:
        for piece in range(-(-most // PIECE)):
            own = [{"k": piece * PIECE, "shift": shift}]
            while at < len(shifts) and shifts[at][0] < (piece + 1) * PIECE:
                shift = shifts[at][1]
                own.append({"k": shifts[at][0], "shift": shift})
                at += 1
            out.append((piece, own, None))
    rows = out + [(None, None, c) for c in lost]
    made = pd.DataFrame(rows, columns=["__piece", "__shifts", "__child"]).astype({"__piece": "Int64"})
    made.insert(0, "__ext", frame["__ext"].iloc[0])
    made.insert(0, "__base", frame["__base"].iloc[0])
    return made


def deal_names(items: DataFrame, name: str, extension: Column | str, order: list[str], taken: DataFrame | None = None, separator: str = "_", first: int = 1, out: str = "file_name", bucket: Column | None = None) -> DataFrame:
    """items with a name each, in column `out`, that neither a taken one (file_name) nor another item has.

    As if items came one by one in the order (columns; ties by name): each gets name + extension, or with separator and
    number, from `first` on, before the extension, the first that is free. extension: a column's name or a value. Items of
    one name are numbered in parts (bucket: see row_numbers()); names that stand already count as ranges. One task holds,
    for one base, the ranges and the other bases that are its name with a number, not its items. Runs jobs when some
    item's own name is another's with a number: what such bases lose to each other is found in as many rounds as names nest.
    """
    ext = F.col(extension) if isinstance(extension, str) else extension
    whole = F.concat(F.coalesce(F.col(name), F.lit("")), F.coalesce(ext, F.lit("")))
    rows = items.withColumns(_parts(whole)).withColumn("__bucket", bucket if bucket is not None else F.lit(0).cast("long"))
    rows = row_numbers(rows, ["__base", "__ext"], order, "__k", None if bucket is None else F.col("__bucket")).withColumn("__k", F.col("__k").cast("long") - 1)
    time = F.struct(*[F.col(c) for c in order]).alias("__t")
    groups = rows.groupBy("__base", "__ext").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(time, "__bucket")).alias("__first"))

    def finished(index: Column, df: DataFrame) -> DataFrame:
        number = F.when(index > 0, F.concat(F.lit(separator), (index + (first - 1)).cast("string"))).otherwise("")
        return df.withColumn(out, F.concat("__base", number, "__ext")).select(*items.columns, out)

    key = ["__base", "__ext"]
    pairs = _numbered(groups, separator, first).select(F.col("__base").alias("child"), "__ext", F.col("__parent").alias("__base"), F.col("__j").alias("lo"), "__first")
    pairs = pairs.join(groups.select(*key, "m"), key).persist()
    nested = not pairs.isEmpty()
    if taken is None and not nested:
        pairs.unpersist()
        return finished(F.col("__k"), rows)
    entries = []
    columns = [*key, "m", "lo", "hi", "before", "child"]
    none = F.lit(None).cast("string").alias("child")
    if taken is not None:
        stands = taken.select(F.col("file_name").alias("__w")).filter("__w is not null").withColumns(_parts(F.col("__w"))).distinct()
        both = stands.select(*key, F.lit(0).cast("long").alias("j")).unionByName(_numbered(stands, separator, first).select(F.col("__parent").alias("__base"), "__ext", F.col("__j").alias("j"))).distinct()
        both = row_numbers(both.join(groups.select(*key), key, "left_semi"), key, ["j"], "__r", F.expr("j div 10000"))
        ranges = both.groupBy(*key, (F.col("j") - F.col("__r")).alias("__run")).agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
        entries.append(ranges.join(groups.select(*key, "m"), key).select(*key, "m", "lo", "hi", F.lit(0).cast("long").alias("before"), none))
    if nested:
        # How many of the parent's items come before the child's first: its place among both, less its place among the children.
        marks = pairs.select(*key, F.col("__first.__t").alias("__t"), F.col("__first.__bucket").alias("__bucket"), F.col("child").alias("__own"), F.lit(True).alias("__mark"))
        own = rows.join(pairs.select(*key).distinct(), key, "left_semi").select(*key, time, "__bucket", F.col("__base").alias("__own"), F.lit(False).alias("__mark"))
        among = row_numbers(own.unionByName(marks), key, ["__t", "__own"], "__u", F.col("__bucket")).filter("__mark")
        behind = row_numbers(marks, key, ["__t", "__own"], "__v", F.col("__bucket")).select(*key, "__own", "__v")
        before = among.join(behind, [*key, "__own"]).select(*key, F.col("__own").alias("child"), (F.col("__u") - F.col("__v")).cast("long").alias("before"))
        entries.append(pairs.join(before, [*key, "child"]).select(*key, "m", "lo", F.col("lo").alias("hi"), "before", "child"))
    known = entries[0].select(columns)
    for more in entries[1:]:
        known = known.unionByName(more.select(columns))
    known = known.persist() if nested else known
    lost: DataFrame | None = None
    while True:
        now = known
        if lost is not None:
            now = known.unionByName(lost.join(groups.select(*key, "m"), key).select(*key, "m", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("before"), none))
        resolved = now.groupBy(*key).applyInPandas(_resolve, _RESOLVED)
        if not nested:
            break
        after = resolved.filter("__child is not null").select(F.col("__child").alias("__base"), "__ext").persist()
        if after.exceptAll(lost).isEmpty() and lost.exceptAll(after).isEmpty() if lost is not None else after.isEmpty():
            break
        lost = after
    pieces = resolved.filter("__piece is not null").select(*key, "__piece", "__shifts")
    placed = rows.withColumn("__piece", F.expr(f"__k div {PIECE}")).join(pieces, [*key, "__piece"], "left")
    shift = F.element_at(F.filter("__shifts", lambda s: s["k"] <= F.col("__k")), -1)["shift"]
    return finished(F.col("__k") + F.coalesce(F.when(F.col("__shifts").isNotNull(), shift), F.lit(0)), placed)
