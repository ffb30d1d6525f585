"""Reading: addresses to nodes, a node's text whole or in windows, lines and contexts cut to a budget, places to names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import text
from treeline.operators.context import HIT
from treeline.operators.context import budgeted as budgeted  # told of here, too
from treeline.plans.compiler import Compiler
from treeline.plans.selector import SelectorError
from treeline.workspace import Workspace

WHOLE = 256 << 10
WINDOW = 2000


def resolved(ws: Workspace, addresses: DataFrame) -> DataFrame:
    """(addr, line, id, cls): the node of each address (addr, line or null): the one whose span begins or holds the line, else the first in order."""
    nodes = ws.nodes.select("addr", "id", "cls", "start", "end", "ord")
    near = addresses.select("addr", F.col("line").cast("int").alias("line")).distinct().join(nodes, "addr")
    rank = F.when(F.col("start") == F.col("line"), 0).when((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end")), 1).otherwise(2)
    at = F.row_number().over(Window.partitionBy("addr", "line").orderBy(rank, "ord", "id"))
    return near.withColumn("at", at).where("at = 1").select("addr", "line", "id", "cls")


def read(ws: Workspace, address: str, offset: int = 1, chars: int = WINDOW) -> DataFrame:
    """(line, text) of the one node at an address: a symbol whole, a file from line ``offset`` for about ``chars`` characters.

    The last row of a window that doesn't reach the end has the line to go on
    with as its ``next``. An address of no node, or of several, is an error.
    """
    found = ws.nodes.where(F.col("addr") == address).select("id", "cls", "start").limit(2).collect()
    if len(found) != 1:
        raise SelectorError(f"{address!r} is {'no node' if not found else 'several nodes; add what tells them apart'}")
    lines = Compiler(ws).source(ws.nodes.where(F.col("addr") == address).select("id")).select("line", "text")
    if found[0]["start"] is not None:
        size = lines.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
        if size > WHOLE:
            raise SelectorError(f"{address!r} has {size} bytes; read a part of it")
        return lines.withColumn("next", F.lit(None).cast("int")).orderBy("line")
    # One file's lines: a single partition here is a file, which the sources keep under a MiB.
    order = Window.partitionBy(F.lit(0)).orderBy("line")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = lines.where(F.col("line") >= offset).withColumns({"before": before, "more": F.lead("line").over(order)})
    seen = seen.where(F.col("before") < chars)
    last = F.max("line").over(Window.partitionBy(F.lit(0)))
    return seen.withColumn("next", F.when(F.col("line") == last, F.col("more")).cast("int")).select("line", "text", "next").orderBy("line")


def capped(line: Column, at: Column, length: Column, width: int = HIT) -> Column:
    """A long line cut to ``width`` characters around a match that begins at ``at`` (from 1), with what is left out counted."""
    size = F.char_length(line)
    lead = F.floor((F.lit(width) - F.least(length, F.lit(width))) / 2).cast("int")
    first = F.greatest(F.lit(1), F.least(at - lead, size - width + 1))
    left = size - width
    return F.when(size <= width, line).otherwise(F.concat(F.substr(line, first, F.lit(width)), F.lit(" (+"), left.cast("string"), F.lit(" chars)")))


def symbols_of(ws: Workspace, path: str) -> DataFrame:
    """(node, type, start, end, depth) of a file's symbols in document order."""
    inside = ws.nodes.where((F.col("path") == path) & (F.col("cls") != "file"))
    return inside.orderBy("ord", "id").select(F.col("addr").alias("node"), F.col("cls").alias("type"), "start", "end", (F.size("anc") - 1).alias("depth"))


def word_at(line: Column, col: Column) -> Column:
    """The identifier that holds or ends at a column (from 1) of a line, or null."""
    head = F.regexp_extract(F.substr(line, F.lit(1), col - 1), "([A-Za-z0-9_]*)$", 1)
    tail = F.regexp_extract(F.substr(line, col, F.char_length(line)), "^([A-Za-z0-9_]*)", 1)
    word = F.concat(head, tail)
    return F.when(word.rlike("^[A-Za-z_]"), word)


def references_at(ws: Workspace, places: DataFrame) -> DataFrame:
    """(path, line, col, name, to_path, to_line, at): every site of the name at each place (path, line, col)."""
    files = ws.nodes.where("file_id = id").select("file_id", F.col("addr").alias("path"))
    named = places.join(files, "path").join(ws.lines, ["file_id", "line"]).select("path", "line", "col", word_at(F.col("text"), F.col("col")).alias("name")).where("name is not null")
    sites = text.sites(ws).select("name", F.col("path").alias("to_path"), F.col("line").alias("to_line"), "at")
    return named.join(sites, "name").select("path", "line", "col", "name", "to_path", "to_line", "at")


def mentions(ws: Workspace, name: str, edited: DataFrame) -> DataFrame:
    """(path, line, col): whole-word places of a name that a plan's positions (path, line, col) don't cover."""
    places = text.search(ws, rf"\b{name}\b").select("path", "line", "col")
    return places.join(edited.select("path", "line", "col").distinct(), ["path", "line", "col"], "left_anti")


def utf16(line: Column, col: Column) -> Column:
    """A column counted in characters as one in UTF-16 units."""
    head = F.substr(line, F.lit(1), col - 1)
    return col + F.char_length(head) - F.char_length(F.regexp_replace(head, "[\\x{10000}-\\x{10FFFF}]", ""))


def collapsed(text_: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_, r"[\s\x0B]+", " "))


def near_names(ws: Workspace, wanted: str, most: int = 3) -> DataFrame:
    """(leaf, distance): the declared names nearest to one that isn't, of lengths within 3 of it."""
    names = ws.nodes.where("cls not in ('project', 'argument', 'return', 'annotation')").select("leaf").distinct()
    near = names.where(F.abs(F.char_length("leaf") - len(wanted)) <= 3).withColumn("distance", F.levenshtein(F.lower("leaf"), F.lit(wanted.lower())))
    return near.orderBy("distance", "leaf").limit(most)


def missing(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): what after has more of than before, as counted rows: new diagnostics, whatever their lines."""
    old = before.groupBy(*columns).agg(F.count(F.lit(1)).alias("was"))
    new = after.groupBy(*columns).agg(F.count(F.lit(1)).alias("now"))
    fits = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    both = new.alias("a").join(old.alias("b"), fits, "left")
    n = F.col("a.now") - F.coalesce("b.was", F.lit(0))
    return both.select(*[F.col(f"a.{c}").alias(c) for c in columns], n.alias("n")).where("n > 0")


def sibling_diagnostics(found: DataFrame, edited: DataFrame, key: str = "path") -> DataFrame:
    """Diagnostics of files other than the edited ones."""
    return found.join(edited.select(key).distinct(), key, "left_anti")
