"""Search, rollups and name statistics over lines and nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import trigrams
from treeline.functions.patterns import to_java
from treeline.operators.context import budgeted
from treeline.operators.intervals import innermost as innermost  # told of here, too
from treeline.plans.selector import Grep
from treeline.workspace import Workspace, written

#: Bytes of a line after which a file counts as generated and is skipped whole.
GENERATED_LINE = 5000


def glob_regex(glob: str) -> str:
    """A file name's pattern (* ? [a-z] [^a-z], a backslash before what stands for itself) as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (shut := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : shut]
            out, i = out + "[" + inner[: inner[0] == "^"] + inner[inner[0] == "^" :].replace("[", r"\[").replace("&", r"\&") + "]", shut
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def _searched(ws: Workspace, pattern: str, path_prefix: str | None, glob: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the files to search, those of them that were generated, the lines of those that may match)."""
    files = ws.nodes.where("cls = 'file'").select("file_id", "path")
    if path_prefix:
        files = files.where(F.col("path").startswith(path_prefix))
    if glob:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(glob_regex(glob)))
    generated = ws.lines.where(F.octet_length("text") > GENERATED_LINE).select("file_id").distinct().join(files, "file_id", "left_semi")
    fit = None if ws.grams is None else trigrams.fitting(ws.grams, Grep(pattern, regex=True))
    return files, generated, ws.lines if fit is None else ws.lines.join(fit, "file_id", "left_semi")


def search(ws: Workspace, pattern: str, path_prefix: str | None = None, limit: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, line, col, hit): every match of a pattern on every line; columns count from 1.

    Files with a line of over GENERATED_LINE bytes are skipped whole. The limit
    keeps the first hits in the order of path, line and column; glob is a pattern
    of the files' own names.
    """
    files, generated, lines = _searched(ws, pattern, path_prefix, glob)
    java = f"(?d){to_java(pattern)}"
    lines = lines.where(F.col("text").rlike(java)).join(files, "file_id").join(generated, "file_id", "left_anti")
    hits = lines.select("path", "line", "text", F.regexp_extract_all("text", F.lit(f"({java})"), F.lit(1)).alias("all"))
    # A match's column: the text up to it, built from the gaps that splitting leaves.
    gaps = hits.withColumn("gaps", F.split("text", java, -1))
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    rows = gaps.select("path", "line", "all", "gaps", F.posexplode("all").alias("at", "hit"))
    out = rows.select("path", "line", (length(F.col("gaps"), F.col("at") + 1) + length(F.col("all"), F.col("at")) + 1).alias("col"), "hit")
    return out if limit is None else out.orderBy("path", "line", "col").limit(limit)


@dataclass
class Found:
    """The first hits (path, line, col, hit, text, before, after), and how many there were: all, past the limit, files skipped as generated and by the index."""

    rows: DataFrame
    hits: int
    dropped: int
    generated: int
    unread: int


def find(ws: Workspace, pattern: str, path_prefix: str | None = None, glob: str | None = None, limit: int = 100, context: int = 0) -> Found:
    """A search with what its answer leaves out, and so many lines of context as fit beside each hit."""
    if limit < 1 or context < 0:
        raise ValueError("limit is 1 or more, context 0 or more")
    files, generated, lines = _searched(ws, pattern, path_prefix, glob)
    hits = search(ws, pattern, path_prefix, None, glob)
    first = written(hits.orderBy("path", "line", "col").limit(limit))
    total = hits.count()
    wanted = first.select("path", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).distinct()
    near = ws.lines.join(files, "file_id").join(wanted, ["path", "line"])
    side = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("line", "text")))), lambda x: x.text)
    framed = near.groupBy("path", "at").agg(F.max(F.when(F.col("line") == F.col("at"), F.col("text"))).alias("text"), side(F.col("line") < F.col("at")).alias("b"), side(F.col("line") > F.col("at")).alias("a"))
    before, after = budgeted(F.col("b"), F.col("text"), F.col("a"))
    framed = framed.select("path", F.col("at").alias("line"), "text", before.alias("before"), after.alias("after"))
    unread = 0 if ws.grams is None else files.join(lines.select("file_id").distinct(), "file_id", "left_anti").count()
    return Found(first.join(framed, ["path", "line"]).orderBy("path", "line", "col"), total, max(0, total - limit), generated.count(), unread)


def rollup(hits: DataFrame, by: str = "node") -> DataFrame:
    """Matches per file over all rows."""
    return hits.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def class_counts(ws: Workspace) -> DataFrame:
    return ws.nodes.groupBy(F.col("cls").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def names(text: Column) -> Column:
    """All identifiers of a line."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def name_freq(ws: Workspace, at_least: int = 1) -> DataFrame:
    """(name, n): how often each identifier occurs on the lines."""
    found = ws.lines.select(F.explode(names(F.col("text"))).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def cardinality(ws: Workspace) -> DataFrame:
    return ws.lines.select(F.explode(names(F.col("text"))).alias("name")).agg(F.countDistinct("name").alias("n"))


def sites(ws: Workspace) -> DataFrame:
    """(name, path, line, at): the identifier's place among those of its line."""
    files = ws.nodes.where("file_id = id").select("file_id", F.col("addr").alias("path"))
    return ws.lines.join(files, "file_id").select("path", "line", F.posexplode(names(F.col("text"))).alias("at", "name"))


def outline(ws: Workspace, limit: int) -> DataFrame:
    """The first ``limit`` nodes in document order, with their depth."""
    return ws.nodes.orderBy("ord", "id").limit(limit).select(F.col("addr").alias("node"), F.col("cls").alias("type"), (F.size("anc") - 1).alias("depth"))


def structure(ws: Workspace, folder: str = "", depth: int | None = None, pattern: str | None = None, limit: int | None = 250) -> DataFrame:
    """(node, type, depth) in document order below a folder, to a depth.

    With a pattern on names: the nodes that match, all that contains them, and
    all below a matching file or symbol; a matching folder keeps only what matches.
    """
    nodes = ws.nodes.where("cls <> 'project'")
    if folder:
        inside = folder.rstrip("/") + "/"
        nodes = nodes.where((F.col("path") == folder) | F.col("path").startswith(inside))
    if pattern is not None:
        hits = nodes.where(F.col("leaf").rlike(f"(?d){to_java(pattern)}"))
        above = hits.select(F.explode("anc").alias("id"))
        whole = hits.where("cls <> 'dir'").select(F.col("id").alias("a"))
        below = nodes.select("id", F.explode("anc").alias("a")).join(whole, "a", "left_semi").select("id")
        nodes = nodes.join(above.union(below).distinct(), "id", "left_semi")
    out = nodes.select(F.col("addr").alias("node"), F.col("cls").alias("type"), (F.size("anc") - 1).alias("depth"), "ord", "id")
    if depth is not None:
        out = out.where(F.col("depth") <= depth + (folder.strip("/").count("/") + 1 if folder.strip("/") else 0))
    out = out.orderBy("ord", "id")
    return (out if limit is None else out.limit(limit)).select("node", "type", "depth")


def tree_sizes(ws: Workspace) -> DataFrame:
    """(node, type, n): how many nodes lie in each folder and file, itself included."""
    above = ws.nodes.select(F.explode("anc").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ws.nodes.where("cls in ('project', 'dir', 'file')").join(above, "id").select(F.col("addr").alias("node"), F.col("cls").alias("type"), "n")


def file_outline(ws: Workspace, path: str, least: int = 1) -> DataFrame:
    """(type, n) of a file's symbols, the most frequent class first, then by name; classes of fewer than ``least`` are left out."""
    inside = ws.nodes.where((F.col("path") == path) & (F.col("cls") != "file"))
    return inside.groupBy(F.col("cls").alias("type")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "type")


def histogram(ws: Workspace) -> DataFrame:
    """(path, type, n): symbols per class in each file."""
    return ws.nodes.where("cls not in ('project', 'dir', 'file')").groupBy("path", F.col("cls").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def nearest_name(ws: Workspace, wanted: str) -> DataFrame:
    """The node name nearest to ``wanted``: edit distance less twice the common prefix, accepted at 1 or less or a prefix of 2."""
    low = F.lower(F.col("leaf"))
    prefix = sum((F.when(F.substring(low, 1, n) == wanted.lower()[:n], 1).otherwise(0) for n in range(1, len(wanted) + 1)), F.lit(0))
    scored = ws.nodes.where("leaf is not null").select("leaf").distinct().select("leaf", (F.levenshtein(low, F.lit(wanted.lower())) - 2 * prefix).alias("score"), prefix.alias("prefix"))
    return scored.where("score <= 1 or prefix >= 2").orderBy("score", "leaf").limit(1).select("leaf", "score")
