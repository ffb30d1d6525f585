"""Merge conflicts in lines: regions, their sides, files as one side has them, diffs.

Only marker lines are windowed; they are few, so no file is held whole. A
region runs from an opening marker to the next closing one with no other
opening between; an opener without a closer is no conflict. A marker is seven
equal characters at a line's start, followed by a space or nothing.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The markers and what follows each.
MARKERS = {"<<<<<<<": "mine", "|||||||": "base", "=======": "theirs", ">>>>>>>": "end"}
SIDES = ("mine", "base", "theirs")


def marks(lines: DataFrame) -> DataFrame:
    """(file_id, line, what, label) of the marker lines of lines (file_id, line, text)."""
    what = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[F.substring("text", 1, 7)]
    return lines.where(F.col("text").rlike(r"^(?:<{7}|\|{7}|={7}|>{7})(?: |$)")).select("file_id", "line", what.alias("what"), F.trim(F.substring("text", 8, 1 << 30)).alias("label"))


def regions(lines: DataFrame) -> DataFrame:
    """(file_id, start, end, mine, base, theirs): each side a struct (label, low, high), low and high null if it is empty; base null without one."""
    found = marks(lines)
    order = Window.partitionBy("file_id").orderBy("line")
    ends = found.where("what in ('mine', 'end')").withColumns({"next": F.lead("what").over(order), "end": F.lead("line").over(order), "end_label": F.lead("label").over(order)})
    whole = ends.where("what = 'mine' and next = 'end'").select("file_id", F.col("line").alias("start"), "end", "end_label")
    opener = F.last(F.when(F.col("what") == "mine", F.col("line")), ignorenulls=True).over(order)
    parts = found.withColumns({"start": opener, "high": F.lead("line").over(order) - 1}).where("what <> 'end'")
    parts = parts.join(whole, ["file_id", "start"]).where("line < end")
    full = F.col("high") > F.col("line")
    span = F.struct("line", "label", F.when(full, F.col("line") + 1).alias("low"), F.when(full, F.col("high")).alias("high"))
    side = lambda name, only=F.lit(True): F.max(F.when((F.col("what") == name) & only, span))
    # A second separator without lines after it leaves the lines after the first.
    out = parts.groupBy("file_id", "start", "end", "end_label").agg(side("mine").alias("m"), side("base").alias("b"), side("theirs", full).alias("t"))
    as_side = lambda c, label: F.struct(label.alias("label"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high"))
    base = F.when(F.col("b").isNotNull(), as_side("b", F.col("b.label")))
    return out.select("file_id", "start", "end", as_side("m", F.col("m.label")).alias("mine"), base.alias("base"), as_side("t", F.col("end_label")).alias("theirs"))


def _joined(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (file_id, low, high and others) with text, the lines from low to high; empty where those are null."""
    keys = spans.columns
    near = spans.alias("s").join(lines.select(F.col("file_id").alias("__file"), "line", "text"), (F.col("file_id") == F.col("__file")) & F.col("line").between(F.col("low"), F.col("high")), "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "text"))))
    return near.groupBy(*keys).agg(F.concat_ws("\n", F.transform(kept, lambda x: x.text)).alias("text"))


def fragments(lines: DataFrame, what: str) -> DataFrame:
    """(file_id, line, label, text): the regions with their markers, or one side of each; an empty side is pinned to the opening marker's line."""
    found = regions(lines)
    if what == "conflict":
        spans = found.select("file_id", F.col("start").alias("line_at"), F.lit("").alias("label"), F.col("start").alias("low"), F.col("end").alias("high"))
    elif what in SIDES:
        spans = found.where(F.col(what).isNotNull()).select("file_id", F.coalesce(F.col(f"{what}.low"), F.col("start")).alias("line_at"), F.col(f"{what}.label").alias("label"), F.col(f"{what}.low").alias("low"), F.col(f"{what}.high").alias("high"))
    else:
        raise ValueError(f"{what} is neither conflict nor a side")
    return _joined(lines, spans).select("file_id", F.col("line_at").alias("line"), "label", "text")


def resolved(lines: DataFrame, side: str) -> DataFrame:
    """lines as they'd be if one side won every conflict, numbered anew; a base that wasn't recorded is empty."""
    if side not in SIDES:
        raise ValueError(f"{side} is no side")
    found = regions(lines).select("file_id", "start", "end", F.col(f"{side}.low").alias("low"), F.col(f"{side}.high").alias("high"))
    gone = F.col("line").between(F.col("start"), F.col("end")) & ~F.coalesce(F.col("line").between(F.col("low"), F.col("high")), F.lit(False))
    drop = lines.select("file_id", "line").join(found, "file_id").where(gone).select("file_id", "line")
    left = lines.join(drop, ["file_id", "line"], "left_anti")
    return left.withColumn("line", F.row_number().over(Window.partitionBy("file_id").orderBy("line")))


def clear_of_conflicts(spans: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans (file_id, start, end and others) that neither start nor end inside a region, and those withheld."""
    found = regions(lines).select(F.col("file_id").alias("__file"), F.col("start").alias("__lo"), F.col("end").alias("__hi"))
    touch = (F.col("file_id") == F.col("__file")) & (F.col("start").between(F.col("__lo"), F.col("__hi")) | F.col("end").between(F.col("__lo"), F.col("__hi")))
    return spans.join(found, touch, "left_anti"), spans.join(found, touch, "left_semi")


def line_diff(mine: list[str], theirs: list[str]) -> str:
    """Lines of both in order: '- ' only mine, '+ ' only theirs, two spaces common; by a longest common subsequence."""
    rows = [array("l", bytes(8 * (len(theirs) + 1)))]
    for a in reversed(mine):
        below, row = rows[-1], array("l", bytes(8 * (len(theirs) + 1)))
        for j in range(len(theirs) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a == theirs[j] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(mine) or j < len(theirs):
        if i < len(mine) and j < len(theirs) and mine[i] == theirs[j]:
            out.append(f"  {mine[i]}")
            i, j = i + 1, j + 1
        elif j == len(theirs) or i < len(mine) and rows[i + 1][j] >= rows[i][j + 1]:
            out.append(f"- {mine[i]}")
            i += 1
        else:
            out.append(f"+ {theirs[j]}")
            j += 1
    return "\n".join(out)


def diff_column(mine: Column, theirs: Column) -> Column:
    """line_diff of two texts; null if either is."""

    def diff(a: str | None, b: str | None) -> str | None:
        return None if a is None or b is None else line_diff(a.split("\n") if a else [], b.split("\n") if b else [])

    return F.udf(diff, "string", useArrow=True)(mine, theirs)
