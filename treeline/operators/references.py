"""References in comments, name lookups over sites, and the catalog of bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.text import sites
from treeline.workspace import Narrowed, Workspace

# What opens a reference in a comment, and how sure it is.
MENTIONS = {r"@see\s+(\S+)": "comment", r"\{@link\s+([^}\s]+)": "comment", r"@ref\s+(\S+)": "declared", r"\bx-(?:ref|source):\s*(\S+)": "declared"}
#: Ranks of confidence, highest first.
RANK = {"declared": 3, "lexical": 2, "comment": 1}


def symbol_of(ref: Column) -> Column:
    """The identifier a reference ends in; null for addresses on the web, positions and what isn't an identifier."""
    bare = F.regexp_replace(F.trim(ref), r"""[,.;:!?)\]}>'"]+$""", "")
    tail = bare
    for sep in ("#", "!", "/", ":", "."):
        tail = F.substring_index(tail, sep, -1)
    name = F.regexp_extract(tail, r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.when(~ref.contains("://") & (name != ""), name)


def comment_refs(ws: Workspace) -> DataFrame:
    """(path, line, name, conf) of references written in comments or as keys."""
    files = ws.nodes.where("file_id = id").select("file_id", F.col("addr").alias("path"))
    def told(pattern: str, conf: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda r: F.struct(r.alias("ref"), F.lit(conf).alias("conf")))

    found = [told(*m) for m in MENTIONS.items()]
    lines = ws.lines.where(F.col("text").rlike("|".join(MENTIONS)))
    refs = lines.select("file_id", "line", F.explode(F.concat(*found)).alias("r")).select("file_id", "line", symbol_of(F.col("r.ref")).alias("name"), F.col("r.conf").alias("conf"))
    return refs.where("name is not null").join(files, "file_id").select("path", "line", "name", "conf")


def occurrences(ws: Workspace, name: str) -> DataFrame:
    """(path, line, at, conf): the name's places, a comment's reference or a declared one above a mere occurrence."""
    files = ws.nodes.where("file_id = id").select("file_id", F.col("addr").alias("path"))
    near = Narrowed(ws, lines=ws.lines.where(F.col("text").contains(name)))
    places = sites(near).where(F.col("name") == name)
    told = comment_refs(near).where(F.col("name") == name).groupBy("path", "line").agg(F.max((F.col("conf") == "declared").cast("int")).alias("told"))
    conf = F.when(F.col("told") == 1, "declared").otherwise("lexical")
    return places.join(told, ["path", "line"], "left").select("path", "line", "at", conf.alias("conf"))


def workspace_symbols(ws: Workspace, part: str) -> DataFrame:
    """(name, path, line, at): sites of all names that hold ``part``, whatever the case."""
    near = Narrowed(ws, lines=ws.lines.where(F.lower("text").contains(part.lower())))
    return sites(near).where(F.lower("name").contains(part.lower())).select("name", "path", "line", "at")


def languages(ws: Workspace) -> DataFrame:
    return ws.nodes.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def bindings(ws: Workspace) -> DataFrame:
    """(name, n_sites, langs): the declared names, with the sites of each and their languages."""
    names = comment_refs(ws).where("conf = 'declared'").select("name").distinct()
    langs = ws.nodes.where("file_id = id").select(F.col("addr").alias("path"), "lang")
    found = sites(ws).join(names, "name", "left_semi").join(langs, "path")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"), F.array_sort(F.collect_set("lang")).alias("langs"))


def ambiguous(ws: Workspace) -> DataFrame:
    """(leaf, n_dirs): names declared in more than one directory, which a rename by name would couple."""
    symbols = ws.nodes.where("cls not in ('project', 'dir', 'file', 'argument', 'return', 'import', 'module')")
    folder = F.regexp_extract("path", "^(.*)/", 1)
    return symbols.select("leaf", folder.alias("dir")).groupBy("leaf").agg(F.countDistinct("dir").alias("n_dirs")).where("n_dirs > 1")
