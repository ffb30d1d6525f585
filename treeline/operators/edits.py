"""Edit plans as rows: renames, and lines with a plan applied. Nothing is written to the files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import references, text
from treeline.workspace import Workspace

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def rename_plan(ws: Workspace, old: str, new: str) -> DataFrame:
    """(path, line, col, old, new, action) for every place of a name.

    'edit' where the line declares the name or refers to it on purpose, and
    everywhere if just one folder declares it; else 'candidate', as the place may
    mean another declaration of that name.
    """
    if not _NAME.fullmatch(old) or not _NAME.fullmatch(new):
        raise ValueError("a name is a letter or underscore, then letters, digits and underscores")
    places = text.search(ws, rf"\b{old}\b").select("path", "line", "col")
    symbols = ws.nodes.where((F.col("leaf") == old) & F.col("start").isNotNull())
    declared = symbols.select("path", F.col("start").alias("line")).union(references.comment_refs(ws).where((F.col("name") == old) & (F.col("conf") == "declared")).select("path", "line")).distinct().withColumn("sure", F.lit(True))
    shared = references.ambiguous(ws).where(F.col("leaf") == old).agg((F.count(F.lit(1)) > 0).alias("shared"))
    out = places.join(declared, ["path", "line"], "left").join(F.broadcast(shared))  # one row
    action = F.when(F.coalesce("sure", F.lit(False)) | ~F.col("shared"), "edit").otherwise("candidate")
    return out.select("path", "line", "col", F.lit(old).alias("old"), F.lit(new).alias("new"), action.alias("action"))


def applied(ws: Workspace, plan: DataFrame) -> DataFrame:
    """(path, line, before, after) of the lines that a plan's edits change; an edit whose old text isn't in its place is left out."""
    files = ws.nodes.where("cls = 'file'").select("file_id", "path")
    by_line = plan.where("action = 'edit'").groupBy("path", "line").agg(F.reverse(F.array_sort(F.collect_set(F.struct("col", "old", "new")))).alias("edits"))
    lines = ws.lines.join(files, "file_id").join(by_line, ["path", "line"])
    # From the right, so that the columns to the left stay true.
    step = lambda done, e: F.when(F.substr(done, e.col, F.length(e.old)) == e.old, F.concat(F.substr(done, F.lit(1), e.col - 1), e.new, F.substr(done, e.col + F.length(e.old)))).otherwise(done)
    return lines.select("path", "line", F.col("text").alias("before"), F.aggregate("edits", F.col("text"), step).alias("after")).where("before <> after")
