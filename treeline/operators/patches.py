"""Edits as plans: unified diffs, moved files, changed signatures, and what a type's empty value is."""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from treeline.operators import text
from treeline.sources import details
from treeline.workspace import Narrowed, Workspace

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def apply_diff(source: str, diff: str) -> str:
    """The text after a unified diff. Lines of context and removal must be as the text has them; a hunk may have moved."""
    lines = source.split("\n")
    out: list[str] = []
    at = 0
    hunks: list[tuple[int, list[str]]] = []
    for row in diff.split("\n"):
        if m := _HUNK.match(row):
            hunks.append((int(m[1]), []))
        elif hunks and row[:1] in (" ", "+", "-"):
            hunks[-1][1].append(row)
        elif hunks and row == "" and row is not diff.split("\n")[-1]:
            hunks[-1][1].append(" ")
    if not hunks:
        raise ValueError("a diff has a hunk at least")
    for n, (first, rows) in enumerate(hunks, 1):
        while rows and rows[-1] == " " and not any(lines[i : i + 1] == [""] for i in range(len(lines))):
            rows.pop()
        old = [r[1:] for r in rows if r[0] != "+"]
        told = max(first - 1, 0) if old else first
        # The nearest place at or after the last hunk where the old lines stand.
        places = [i for i in range(at, len(lines) - len(old) + 1) if lines[i : i + len(old)] == old]
        if not places:
            raise ValueError(f"hunk {n} doesn't fit the text")
        place = min(places, key=lambda i: (abs(i - told), i))
        out += lines[at:place]
        out += [r[1:] for r in rows if r[0] != "-"]
        at = place + len(old)
    return "\n".join(out + lines[at:])


def patched(source: Column, diff: Column) -> Column:
    """The text after a diff, row by row; null where it doesn't fit."""

    @arrow_udf("string")
    def run(sources: pa.Array, diffs: pa.Array) -> pa.Array:
        out = []
        for s, d in zip(sources.to_pylist(), diffs.to_pylist(), strict=True):
            try:
                out.append(None if s is None or d is None else apply_diff(s, d))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(source, diff)


def write_atomic(path: str, content: str) -> None:
    """Writes a local file in one step: readers see the old text or the new."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, draft = tempfile.mkstemp(dir=folder, prefix=".draft-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


# Endings that a relative import leaves out, in the order they are tried.
_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
_IMPORT = re.compile(r"(\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(['\"])(\.[^'\"]*)\2")


def _bare(path: str) -> str:
    for ending in sorted(_ENDINGS, key=len, reverse=True):
        if path.endswith(ending):
            return path[: -len(ending)]
    return path


def _relative(target: str, folder: str) -> str:
    out = posixpath.relpath(target, folder or ".")
    return out if out.startswith(".") else f"./{out}"


def moved_imports(path: str, content: str, old: str, new: str) -> list[tuple[int, int, str, str]]:
    """(line, column, old, new) of a file's relative imports that moving ``old`` to ``new`` changes; the moved file's own as well."""
    out = []
    here, there = posixpath.dirname(path), posixpath.dirname(new if path == old else path)
    for n, line in enumerate(content.split("\n"), 1):
        for m in _IMPORT.finditer(line):
            target = posixpath.normpath(posixpath.join(here, m[3]))
            hit = target == old or _bare(old) == target or _bare(target) == _bare(old)
            if path == old:
                fresh = _relative(_bare(new) if hit else target, there)
            elif hit:
                ending = m[3][len(_bare(m[3])) :] if target != _bare(target) else ""
                fresh = _relative(_bare(new), there) + (posixpath.splitext(new)[1] if ending and not ending.startswith("/") else "")
            else:
                continue
            if fresh != m[3]:
                out.append((n, m.start(3) + 1, m[3], fresh))
    return out


def move_plan(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line, col, old, new, action): the import edits of moving a file, and one row 'move' for the file itself."""
    if old == new or not new:
        raise ValueError("a file moves to another path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *e, "edit") for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in moved_imports(p, t or "", old, new)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()], strict=True)], ["path", "line", "col", "old", "new", "action"])

    near = files.where(F.col("path").rlike(r"\.(tsx?|jsx?|mjs|cjs)$")).select("path", "content")
    edits = near.mapInArrow(run, "path string, line int, col int, old string, new string, action string")
    return edits.unionByName(files.where(F.col("path") == old).select("path", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit("move").alias("action")))


def zero_value(type_: str, lang: str) -> str:
    """The empty value of a type, as source text."""
    t = type_.strip().rstrip("?")
    numbers = re.compile(r"(?:u?int(?:8|16|32|64|ptr)?|float(?:32|64)?|byte|rune|number|long|short|double|Int|Long|Short|Byte|Double|Float|complex\w*|size_t)$")
    if lang == "python":
        return {"int": "0", "float": "0.0", "str": '""', "bool": "False", "list": "[]", "dict": "{}", "tuple": "()", "bytes": 'b""', "set": "set()"}.get(re.sub(r"\[.*", "", t), "None")
    if lang == "go":
        if t.startswith(("*", "[]", "map[", "chan ", "func(")) or t in ("error", "any") or t.startswith("interface"):
            return "nil"
        return '""' if t == "string" else "false" if t == "bool" else "0" if numbers.match(t) else f"{t}{{}}"
    if type_.strip().endswith("?"):
        return "null"
    if t in ("string", "String"):
        return '""' if t == "string" and lang == "typescript" or lang == "kotlin" else "null"
    if t in ("boolean", "bool", "Boolean"):
        return "false" if t != "Boolean" or lang == "kotlin" else "null"
    if numbers.match(t):
        return "0"
    if lang == "typescript":
        return "[]" if t.endswith("[]") or t.startswith("Array<") else "undefined"
    return "NULL" if lang in ("c", "cpp") else "null"


def _arguments(plain: str, open_: int) -> tuple[int, list[str], list[tuple[int, int]]]:
    """(place of the closing bracket, arguments, their places) of the call whose bracket stands at ``open_``."""
    shut = details.closing(plain, open_, "()")
    spans, depth, first = [], 0, open_ + 1
    for i in range(open_ + 1, shut + 1):
        c = plain[i] if i < len(plain) else ")"
        if i == shut or c == "," and depth == 0:
            spans.append((first, i))
            first = i + 1
        depth += (c in "([{") - (c in ")]}")
    return shut, [plain[a:b].strip() for a, b in spans], spans


def call_rewrites(content: str, plain: str, name: str, before: list[str], after: list[str], lang: str, declared: frozenset[tuple[int, int]] = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """(line, column, old, new, action) for each call of a function whose parameters change from ``before`` to ``after`` (texts "name type").

    A parameter that stays keeps its argument, by name; a new one gets its type's
    empty value, one that goes loses its argument. A call that spreads a list, or
    has another number of arguments, is a candidate and stays as it is.
    """
    bare = lambda p: re.match(r"\s*(?:\.\.\.)?\*?(\w+)", p)[1]
    kind = lambda p: re.sub(r"^\s*\w+\s*:?\s*", "", p)
    old_names = [bare(p) for p in before]
    places, out = details.Text(plain), []
    for m in re.finditer(rf"(?<![\w.])(?:\w+\.)*{re.escape(name)}\s*\(", plain):
        head = plain[: m.start()].rstrip()
        own = plain.rfind(name, m.start(), m.end())
        if (places.line(own), places.column(own)) in declared or re.search(r"\b(?:func|def|function|fun)(?:\s*\([^()]*\))?$", head):
            continue
        shut, args, spans = _arguments(plain, m.end() - 1)
        given = [content[a:b].strip() for a, b in spans] if args != [""] else []
        at = m.end()
        line, col = places.line(at), places.column(at)
        old = content[at:shut]
        if any(a.startswith(("...", "*")) or a.endswith("...") for a in given) or len(given) != len(before):
            out.append((line, col, old, old, "candidate"))
            continue
        new = ", ".join(given[old_names.index(bare(p))] if bare(p) in old_names else zero_value(kind(p), lang) for p in after)
        if new != old:
            out.append((line, col, old, new, "edit"))
    return out


def signature_plan(ws: Workspace, files: DataFrame, name: str, before: list[str], after: list[str], lang: str) -> DataFrame:
    """(path, line, col, old, new, action) of the calls that a function's new parameters change, in files of its language."""
    from treeline.sources.code import declarations, language, plain_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *e) for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in call_rewrites(t, plain_text(t, lang), name, before, after, lang, frozenset((d[5], d[6]) for d in declarations(t, lang)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()], strict=True)], ["path", "line", "col", "old", "new", "action"])

    near = files.where((language() == lang) & F.col("content").contains(name)).select("path", "content")
    return near.mapInArrow(run, "path string, line int, col int, old string, new string, action string")


def variance(sites: DataFrame, mode: str) -> DataFrame:
    """What a rename does to derived sources (path, line, derived): 'strict' stops, 'follow' edits them, 'warn' leaves them with a note."""
    actions = {"strict": "refuse", "follow": "edit", "warn": "note"}
    if mode not in actions:
        raise ValueError(f"a mode is one of {', '.join(actions)}")
    return sites.withColumn("action", F.when(F.col("derived"), F.lit(actions[mode])).otherwise("edit"))


def comment_mentions(ws: Workspace, name: str) -> DataFrame:
    """(path, line, col): a name's whole-word places on lines that are comments."""
    lines = ws.lines.where(F.col("text").rlike(r"^\s*(?://|#|/?\*|--|<!--)"))
    return text.search(Narrowed(ws, lines=lines), rf"\b{name}\b").select("path", "line", "col")
