"""Declared bindings and schemas: names that one file declares and others use, from configuration or found in files.

A configuration has ``bindings`` (a name with sites) and ``schemas`` (files whose
entities are names). A site is a symbol of a file, a path into a JSON or YAML
file, or a regular expression over a file's lines. Sites that lead nowhere are
rows of their own, not errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.patterns import to_java
from treeline.operators import text
from treeline.plans.selector import SelectorError
from treeline.workspace import Workspace

MOST_SCHEMA = 5 << 20
SITE = "name string, kind string, path string, what string"
_ENTITY = "path string, name string, kind string, line int, col int"


def parsed(raw: str | None) -> object:
    """A JSON document, or a YAML one where a YAML reader is at hand; None for what is neither."""
    if not raw:
        return None
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        pass
    try:
        import yaml

        return yaml.safe_load(raw)
    except Exception:  # noqa: BLE001 - no reader, or no YAML: the file isn't data
        return None


def config(spark: SparkSession, raw: str) -> dict[str, DataFrame]:
    """Tables ``languages`` (ext, lang), ``sites`` (name, kind, path, what) and ``schemas`` (path, kind) of a configuration's text."""
    data = parsed(raw)
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    sites = []
    for binding in data.get("bindings") or []:
        for site in binding.get("sites") or []:
            kinds = [k for k in ("symbol", "jsonpath", "regex") if k in site]
            if len(kinds) != 1 or "file" not in site:
                raise ValueError(f"a site of {binding.get('name')!r} has a file and one of symbol, jsonpath, regex")
            sites.append((binding["name"], kinds[0], site["file"], str(site[kinds[0]])))
    languages = [(ext.lstrip("."), lang) for lang, exts in (data.get("languages") or {}).items() for ext in exts]
    schemas = [(s["file"], s.get("type", "auto")) for s in data.get("schemas") or []]
    return {"languages": spark.createDataFrame(languages, "ext string, lang string"), "sites": spark.createDataFrame(sites, SITE), "schemas": spark.createDataFrame(schemas, "path string, kind string")}


_STEP = re.compile(r"\.([\w\-$]+)|\[\s*(\d+|\*|'[^']*'|\"[^\"]*\")\s*\]")


def walk_path(data: object, path: str) -> list[object]:
    """The values that a path such as ``$.a[0]['b'].*`` leads to in a document."""
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path!r}")
    rest, values = path[1:].replace(".*", "[*]"), [data]
    while rest:
        m = _STEP.match(rest)
        if not m:
            raise ValueError(f"unexpected {rest!r} in {path!r}")
        rest = rest[m.end() :]
        key = m[1] if m[1] is not None else m[2].strip("'\"") if m[2][0] in "'\"" else m[2]
        if m[2] == "*":
            values = [x for v in values for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [])]
        elif m[2] and m[2].isdigit():
            values = [v[int(key)] for v in values if isinstance(v, list) and int(key) < len(v)]
        else:
            values = [v[key] for v in values if isinstance(v, dict) and key in v]
    return values


def applied(ws: Workspace, files: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, failed): the places of declared sites (name, path, line, col, conf), and sites that have none (name, kind, path, what, why)."""
    known = files.select("path").withColumn("there", F.lit(True))
    rows = sites.join(known, "path", "left").select("name", "kind", "path", "what", F.coalesce("there", F.lit(False)).alias("there"))
    symbols = ws.nodes.where("start is not null").select("path", F.col("full").alias("what"), F.col("start").alias("line"), F.col("leaf"))
    by_symbol = rows.where("kind = 'symbol'").join(symbols, ["path", "what"]).select("name", "kind", "path", "what", "line", F.lit(1).alias("col"))

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first line of each value that a JSON path leads to and whose text names it."""
        for batch in batches:
            out: list[tuple] = []
            for name, kind, path, what, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    values = walk_path(parsed(content), what)
                except ValueError:
                    values = []
                for v in values:
                    wanted = v if isinstance(v, str) else json.dumps(v) if not isinstance(v, (dict, list)) else re.findall(r"[\w\-$]+", what)[-1]
                    place = next(((n, line.index(wanted) + 1) for n, line in enumerate(content.split("\n"), 1) if wanted and wanted in line), (1, 1))
                    out.append((name, kind, path, what, *place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string()] * 4 + [pa.int32()] * 2, strict=True)], ["name", "kind", "path", "what", "line", "col"])

    by_path = rows.where("kind = 'jsonpath' and there").join(files.select("path", "content"), "path").select("name", "kind", "path", "what", "content").mapInArrow(lines_of, "name string, kind string, path string, what string, line int, col int")
    parts = [by_symbol, by_path]
    wrong = []
    for r in sites.where("kind = 'regex'").select("what").distinct().collect():  # the configuration's own patterns
        try:
            hits = text.search(ws, r["what"]).select("path", "line", "col")
        except SelectorError:
            wrong.append(r["what"])
            continue
        parts.append(rows.where((F.col("kind") == "regex") & (F.col("what") == r["what"])).join(hits, "path").select("name", "kind", "path", "what", "line", "col"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    why = F.when(~F.col("there"), "no such file").when(F.col("what").isin(wrong) if wrong else F.lit(False), "the pattern can't be read").otherwise("nothing found")
    failed = rows.join(found.select("name", "kind", "path", "what").distinct(), ["name", "kind", "path", "what"], "left_anti").select("name", "kind", "path", "what", why.alias("why"))
    return found.select("name", "path", "line", "col", F.lit("declared").alias("conf")), failed


def regex_names(ws: Workspace, pattern: str, path_pattern: str = ".*") -> DataFrame:
    """(path, line, name): the first group, or the whole match, of a pattern on the lines of files whose path fits."""
    java = f"(?d){to_java(pattern)}"
    groups = len(re.findall(r"(?<!\\)\((?!\?)|\(\?P?<", pattern))
    files = ws.nodes.where("cls = 'file'").where(F.col("path").rlike(f"(?d){to_java(path_pattern)}")).select("file_id", "path")
    names = F.regexp_extract_all("text", F.lit(java if groups else f"({java})"), F.lit(1))
    return ws.lines.join(files, "file_id").select("path", "line", F.explode(names).alias("name"))


def schema_kind(path: str, content: str | None) -> str | None:
    """What kind of schema a file is: proto, jsonschema or openapi; None for others and for files over MOST_SCHEMA."""
    if content is None or len(content) > MOST_SCHEMA:
        return None
    if path.endswith(".proto"):
        return "proto"
    if not re.search(r"\.(json|ya?ml)$", path):
        return None
    if path.endswith(".schema.json"):
        return "jsonschema"
    data = parsed(content)
    if not isinstance(data, dict):
        return None
    return "openapi" if "openapi" in data or "swagger" in data else "jsonschema" if "$schema" in data else None


def entities_of(kind: str, content: str) -> list[tuple[str, str]]:
    """(name, what) that a schema declares: messages, services and calls; definitions and properties; operations and components."""
    if kind == "proto":
        bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", content, flags=re.S)
        return [(m[2], m[1]) for m in re.finditer(r"\b(message|enum|service|rpc)\s+(\w+)", bare)]
    data = parsed(content)
    if not isinstance(data, dict):
        return []
    out: list[tuple[str, str]] = []
    if kind == "openapi":
        for path in (data.get("paths") or {}).values():
            out += [(op["operationId"], "operation") for op in (path or {}).values() if isinstance(op, dict) and isinstance(op.get("operationId"), str)]
        out += [(name, "schema") for name in {**(data.get("definitions") or {}), **((data.get("components") or {}).get("schemas") or {})}]
        return out
    if isinstance(data.get("title"), str):
        out.append((data["title"], "schema"))
    out += [(name, "schema") for key in ("definitions", "$defs") for name in data.get(key) or {}]
    return out + [(name, "property") for name in data.get("properties") or {}]


def entities(files: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, line, col) of what schema files declare: those named (path, kind), or all that look like schemas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = told if told and told != "auto" else schema_kind(path, content)
                for name, what in entities_of(kind, content) if kind and content else []:
                    m = re.search(rf"(?<!\w){re.escape(name)}(?!\w)", content)
                    at = m.start() if m else 0
                    out.append((path, name, what, content.count("\n", 0, at) + 1, at - content.rfind("\n", 0, at)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string()] * 3 + [pa.int32()] * 2, strict=True)], [c.split()[0] for c in _ENTITY.split(", ")])

    rows = files.select("path", "content", F.lit("auto").alias("told")) if schemas is None else files.join(schemas, "path").select("path", "content", F.col("kind").alias("told"))
    likely = rows.where(F.col("path").rlike(r"\.(proto|json|ya?ml)$"))
    return likely.mapInArrow(run, _ENTITY)


def promoted(ws: Workspace, declared: DataFrame) -> DataFrame:
    """(name, path, line, conf): a schema's names (path, name, line) and every other site of them."""
    names = declared.select("name").distinct()
    sites = text.sites(ws).join(names, "name", "left_semi").select("name", "path", "line")
    own = declared.select("name", "path", "line").distinct()
    both = own.withColumn("conf", F.lit("declared")).unionByName(sites.distinct().join(own, ["name", "path", "line"], "left_anti").withColumn("conf", F.lit("promoted")))
    return both


def resource_links(ws: Workspace) -> DataFrame:
    """(name, kind, declared_in, line, used_in, used_line): resources that XML declares and code names as R.kind.name; both sides exist."""
    files = ws.nodes.where("cls = 'file'").select("file_id", "path")
    lines = ws.lines.join(files, "file_id")
    tags = lines.where(F.col("path").endswith(".xml"))
    by_id = tags.select(F.col("path").alias("declared_in"), "line", F.explode(F.regexp_extract_all("text", F.lit(r"@\+id/([A-Za-z_]\w*)"), F.lit(1))).alias("name")).withColumn("kind", F.lit("id"))
    element = F.regexp_extract("text", r"<(string|color|dimen|style|bool|integer|drawable|layout)\b[^>]*\bname\s*=\s*[\"']([A-Za-z_]\w*)[\"']", 1)
    by_name = tags.select(F.col("path").alias("declared_in"), "line", F.regexp_extract("text", r"<\w+\b[^>]*\bname\s*=\s*[\"']([A-Za-z_]\w*)[\"']", 1).alias("name"), element.alias("kind")).where("kind <> ''")
    uses = lines.where(F.col("path").rlike(r"\.(java|kt|kts|groovy)$")).select(F.col("path").alias("used_in"), F.col("line").alias("used_line"), F.explode(F.regexp_extract_all("text", F.lit(r"\bR\.(\w+\.\w+)"), F.lit(1))).alias("use"))
    uses = uses.select("used_in", "used_line", F.split("use", r"\.")[0].alias("kind"), F.split("use", r"\.")[1].alias("name"))
    return by_id.unionByName(by_name).join(uses, ["name", "kind"]).distinct()


def folded_name(name: Column) -> Column:
    """A name without case and underscores, as generated code writes a column's."""
    return F.lower(F.regexp_replace(name, "_", ""))


def derived_columns(ws: Workspace, columns: DataFrame) -> DataFrame:
    """(table, column, path, line, what): places marked ``derived:"table.column"`` whose column is alive (table, column)."""
    files = ws.nodes.where("cls = 'file'").select("file_id", "path")
    marks = ws.lines.join(files, "file_id").select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"derived:\"(\w+\.\w+)\""), F.lit(1))).alias("what"))
    marks = marks.withColumns({"t": folded_name(F.split("what", r"\.")[0]), "c": folded_name(F.split("what", r"\.")[1])})
    return columns.select("table", "column", folded_name(F.col("table")).alias("t"), folded_name(F.col("column")).alias("c")).join(marks, ["t", "c"]).select("table", "column", "path", "line", "what")


def derived_operations(ws: Workspace, operations: DataFrame) -> DataFrame:
    """(name, path, line): string literals of code that are an operation's name (name)."""
    files = ws.nodes.where("cls = 'file' and lang is not null").select("file_id", "path")
    literals = ws.lines.join(files, "file_id").select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[\"'`]([A-Za-z_]\w*)[\"'`]"), F.lit(1))).alias("name"))
    return literals.join(operations.select("name").distinct(), "name", "left_semi").select("name", "path", "line").distinct()


def coupled(ambiguous: DataFrame, declared: DataFrame) -> DataFrame:
    """Names declared in several folders (leaf) that no declared site (name) couples: a rename by name would mix them."""
    return ambiguous.join(declared.select(F.col("name").alias("leaf")).distinct(), "leaf", "left_anti")
