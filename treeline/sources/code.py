"""Workspaces over source trees: files, declarations, name sites and reference edges.

Files come as (path, content). A pandas-free Arrow pass per file makes flat
declarations and sites: Python by its own parser, Go and TypeScript by a
scanner of braces and declaration heads. Trees and edges are then joins.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.sources import details, languages
from treeline.sources.tables import split_lines
from treeline.workspace import LinkedWorkspace, Workspace, both_directions, node_id, project, root, written

# Extensions and languages; folders that hold no source.
EXTENSIONS = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "groovy": "groovy", "gradle": "groovy", "gvy": "groovy", "gy": "groovy", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "sql": "sql", "psql": "sql", "xml": "xml", "md": "markdown", "markdown": "markdown"}
BRACED = ("go", "typescript")
NOISE = (".git", "node_modules", "vendor", "__pycache__", "dist", "build", ".idea", ".vscode", "_fixture")
# Words of each language, and names of its basic types, that are never references.
_CURLY = "abstract break case catch class continue default do else enum extends final finally for if import instanceof interface new package private protected public return static super switch this throw throws try void while"
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 byte rune float32 float64 bool any error true false nil iota",
    "typescript": f"{_CURLY} any as async await boolean const constructor delete export from function get implements in let never null number object of readonly set string true false type typeof undefined unknown var yield",
    "python": f"{' '.join(keyword.kwlist)} int float str bool bytes list dict tuple set frozenset type object print len range self cls",
    "java": f"{_CURLY} assert boolean byte char double float implements int long native null record short synchronized true false transient var volatile String Object Integer Boolean Long Double Float Byte Short Character Void",
    "kotlin": f"{_CURLY} as by companion constructor data fun in init inline internal is it null object open out override sealed suspend true false typealias val var when where String Int Long Short Byte Boolean Char Float Double Unit Any Nothing Array List Map Set Pair",
    "groovy": f"{_CURLY} as assert boolean byte char def double float implements in int it long null short trait true false String Object Integer Boolean Long Double Float Byte Short Character List Map Set",
    "c": f"{_CURLY} auto char const delete double extern explicit float friend goto inline int long namespace operator override register short signed sizeof struct template typedef typename union unsigned using virtual volatile NULL nullptr true false size_t ssize_t ptrdiff_t wchar_t bool int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t intptr_t uintptr_t",
    "sql": "add all alter and as asc begin between by case check constraint create cross default delete desc distinct drop else end exists foreign from function group having if in index inner insert into is join key left like limit not null on or order outer primary references returning returns right select set table then trigger union unique update using values view when where with",
}
WORDS = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()} | {"cpp": frozenset(KEYWORDS["c"].split())}
MOST_BYTES = 1 << 20
#: Rows of many small files go back to Spark together, as a batch costs more than a file.
BATCH_ROWS = 4096
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
DECLS = "path string, sym string, cls string, leaf string, start int, end int, name_line int, name_col int, body_line int, at int, above array<string>, comment_start int, comment_end int"
SITES = "path string, name string, line int, col int, kind string, pos string, host string, encl string"
_DECL_TYPES = [pa.string()] * 4 + [pa.int32()] * 6 + [pa.list_(pa.string()), pa.int32(), pa.int32()]
_SITE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]

Decl = tuple  # (sym, cls, leaf, start, end, name_line, name_col, body_line)


def python_decls(text: str) -> list[Decl]:
    out: list[Decl] = []
    lines = text.split("\n")

    def visit(body: list, prefix: str, in_class: bool) -> None:
        for n in body:
            start = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = "class" if isinstance(n, ast.ClassDef) else "ctor" if in_class and n.name == "__init__" else "method" if in_class else "func"
                sym = prefix + n.name
                name_col = len(lines[n.lineno - 1]) - len(re.sub(r"^\s*(?:async\s+)?(?:def|class)\s+", "", lines[n.lineno - 1])) + 1
                out.append((sym, cls, n.name, start, n.end_lineno, n.lineno, name_col, n.body[0].lineno - 1))
                if cls != "class":
                    a = n.args
                    for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
                        if not (in_class and x.arg in ("self", "cls")):
                            out.append((f"{sym}.{x.arg}", "argument", x.arg, x.lineno, x.end_lineno, x.lineno, x.col_offset + 1, 0))
                visit(n.body, sym + ".", isinstance(n, ast.ClassDef))
            elif isinstance(n, (ast.Import, ast.ImportFrom)) and not prefix:
                for x in n.names:
                    name = x.asname or x.name.split(".")[-1]
                    out.append((name, "import", name, start, n.end_lineno, n.lineno, n.col_offset + 1, 0))
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and (in_class or not prefix):
                for x in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(x, ast.Name):
                        out.append((prefix + x.id, "field" if in_class else "var", x.id, start, n.end_lineno, x.lineno, x.col_offset + 1, 0))

    visit(ast.parse(text).body, "", False)
    return out


def _blank(text: str) -> str:
    """Comments and strings as spaces, line feeds kept."""
    return re.sub(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


_GO = re.compile(r"^[ \t]*(?:func\s*(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<func>\w+)|type\s+(?P<type>\w+)(?:[^\n{]*?\b(?P<form>struct|interface)\b)?|(?P<value>var|const)\s+(?:(?P<name>\w+)|(?P<many>\())|package\s+(?P<package>\w+))", re.M)
_TS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(?P<func>\w+)|(?:abstract\s+)?class\s+(?P<cls>\w+)|interface\s+(?P<iface>\w+)|type\s+(?P<type>\w+)\s*[=<]|enum\s+(?P<enum>\w+)|(?P<value>const|let|var)\s+(?P<name>\w+))", re.M)
_TS_MEMBER = re.compile(r"^[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?\s+)*(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*(?P<name>\w+)\s*(?P<what>[(<:=;?])", re.M)
_TS_IMPORT = re.compile(r"^[ \t]*import\b[^;\n]*?from\s*['\"](?P<from>[^'\"]+)['\"]|^[ \t]*import\s*['\"](?P<only>[^'\"]+)['\"]", re.M)
_GO_IMPORT = re.compile(r"^[ \t]*import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]*))", re.M)


def _close(text: str, at: int, pair: str) -> int:
    """Place of the bracket that closes the one at ``at``; the last place of the text if none does."""
    return min(details.closing(text, at, pair), len(text) - 1)


def brace_decls(text: str, lang: str) -> list[Decl]:
    plain = _blank(text)
    places = details.Text(plain)
    line_of, column = places.line, places.column
    out: list[Decl] = []

    def head(m: re.Match) -> int:
        return m.start() + len(m[0]) - len(m[0].lstrip())

    def add(sym: str, cls: str, name: str, first: int, last: int, name_at: int, body: int = 0) -> None:
        out.append((sym, cls, name, line_of(first), line_of(last), line_of(name_at), column(name_at), line_of(body) if body else 0))

    def callable_(sym: str, cls: str, name: str, first: int, name_at: int) -> int:
        open_ = plain.find("(", name_at)
        if open_ < 0:
            return name_at
        shut = _close(plain, open_, "()")
        stop = plain.find("\n", shut)
        stop = len(plain) if stop < 0 else stop
        brace = plain.find("{", shut, stop)
        # An interface type in a result isn't the body.
        while brace >= 0 and re.search(r"(?:interface|struct)\s*$", plain[shut:brace]):
            brace = plain.find("{", _close(plain, brace, "{}") + 1, stop)
        last = _close(plain, brace, "{}") if brace >= 0 else stop - 1
        add(sym, cls, name, first, last, name_at, brace if brace >= 0 else 0)
        at = open_ + 1
        for part in re.split(r",(?![^(\[{<]*[)\]}>])", plain[open_ + 1 : shut]):
            x = re.match(r"\s*(?:\.\.\.)?(?:(?:public|private|readonly)\s+)*(\w+)", part)
            if x and (lang != "go" or re.match(r"\s*\w+(?:\s+\S|\s*$)", part)):
                add(f"{sym}.{x[1]}", "argument", x[1], at + x.start(1), at + len(part) - 1, at + x.start(1))
            at += len(part) + 1
        return last

    done = -1
    for m in (_GO if lang == "go" else _TS).finditer(plain):
        first = head(m)
        if first <= done:
            continue
        g = m.groupdict()
        if g.get("func"):
            recv = g.get("recv")
            sym = f"{recv}.{g['func']}" if recv else g["func"]
            done = callable_(sym, "method" if recv else "func", g["func"], first, m.start("func"))
        elif g.get("package"):
            add(g["package"], "module", g["package"], first, m.end(), m.start("package"))
        elif g.get("many"):
            done = _close(plain, m.start("many"), "()")
            for f in re.compile(r"^[ \t]*(\w+)\b[^\n]*", re.M).finditer(plain, plain.find("\n", m.end()) + 1, done):
                add(f[1], "const" if g["value"] == "const" else "var", f[1], f.start(1), f.end() - 1, f.start(1))
        elif g.get("value"):
            stop = plain.find("\n", m.end())
            add(g["name"], "const" if g["value"] == "const" else "var", g["name"], first, (len(plain) if stop < 0 else stop) - 1, m.start("name"))
        else:
            kind = next(k for k in ("type", "cls", "iface", "enum") if g.get(k))
            brace = plain.find("{", m.end() - 1)
            stop = plain.find("\n", m.end())
            own = brace >= 0 and (stop < 0 or brace < stop or kind != "type")
            done = _close(plain, brace, "{}") if own else (len(plain) if stop < 0 else stop) - 1
            cls = {"cls": "class", "iface": "interface", "enum": "enum"}.get(kind) or g.get("form") or "type"
            add(g[kind], cls, g[kind], first, done, m.start(kind), brace if own else 0)
            if own and lang == "go" and cls == "struct":
                for f in re.finditer(r"^[ \t]*(\w+)[ \t]+\S", plain[brace + 1 : done], re.M):
                    add(f"{g[kind]}.{f[1]}", "field", f[1], brace + 1 + f.start(1), brace + f.end(), brace + 1 + f.start(1))
            if own and (cls == "class" or lang != "go" and cls == "interface"):
                at = brace + 1
                while at < done and (f := _TS_MEMBER.search(plain, at, done)):
                    name_at = f.start("name")
                    if f["what"] in "(<":
                        ctor = f["name"] == "constructor"
                        at = max(callable_(f"{g[kind]}.{f['name']}", "ctor" if ctor else "method", f["name"], head(f), name_at), f.end())
                    else:
                        stop = plain.find("\n", f.end())
                        at = done if stop < 0 else min(stop, done)
                        add(f"{g[kind]}.{f['name']}", "field", f["name"], head(f), at - 1, name_at)
    imports = _GO_IMPORT.finditer(text) if lang == "go" else _TS_IMPORT.finditer(text)
    for m in imports:
        body = m[0] if lang != "go" else m["many"] or m["one"] or ""
        for alias, path in re.findall(r"(\w+\s+)?[\"']([^\"']+)[\"']", body):
            parts = [p for p in path.split("/") if not re.fullmatch(r"v\d+", p)]
            name = (alias.strip() if lang == "go" and alias.strip() else "") or parts[-1].split(".")[-1 if lang == "go" else 0]
            if name:
                add(name, "import", name, head(m), m.end() - 1, head(m))
    return sorted(out, key=lambda d: (d[3], d[6]))


def plain_text(text: str, lang: str) -> str:
    """The text with comments and strings as spaces, places kept."""
    if lang == "python":
        return re.sub(r"#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    if lang in ("xml", "markdown"):
        return text
    return languages.blank(text, sql=True) if lang == "sql" else _blank(text)


def graphql_names(text: str) -> list[tuple[str, int]]:
    """(name, place) in GraphQL documents that TypeScript holds as template literals, without variables, strings and comments."""
    out = []
    for m in re.finditer(r"\b(?:graphql|gql)\s*\(?\s*`([^`]*)`", text):
        body = re.sub(r"#[^\n]*|\"[^\"\n]*\"|\$\{[^}]*\}|\$\w+", lambda x: " " * len(x[0]), m[1])
        words = [x for x in _NAME.finditer(body) if x[0] not in ("query", "mutation", "subscription", "fragment", "on", "true", "false", "null")]
        out += [(x[0], m.start(1) + x.start()) for x in words]
    return out


def sites_of(text: str, lang: str) -> list[tuple[str, int, int, str]]:
    """(name, line, column, kind) of every identifier outside comments and strings that is no keyword."""
    if lang == "markdown":
        return [(*name, "") for name in languages.markdown_names(text)]
    if lang == "xml":
        # Names of elements, and names in values that name or refer to something.
        at = details.Text(text)
        found = [m for m in re.finditer(r"</?([A-Za-z_][\w.]*)|\b(?:name|key|id)\s*=\s*[\"']([A-Za-z_]\w*)[\"']|@\+?(?:[\w.]+:)?\w+/([A-Za-z_]\w*)", text) if not m[0].startswith("</")]
        return [(m[m.lastindex], at.line(m.start(m.lastindex)), at.column(m.start(m.lastindex)), "") for m in found]
    plain, words = plain_text(text, lang), WORDS.get(lang, frozenset())
    out = []
    for n, line in enumerate(plain.split("\n"), 1):
        importing = bool(re.match(r"\s*(?:import|from)\b", line))
        for m in _NAME.finditer(line):
            if m[0] in words or lang == "sql" and m[0].lower() in words:
                continue
            before, after = line[: m.start()].rstrip(), line[m.end() :]
            kind = "import" if importing else "call" if re.match(r"\s*\(", after) else ""
            if not kind and (re.search(r"(?:\bnew|\bextends|\bimplements|:|\*|\[\]|->)$", before) or lang == "go" and re.search(r"[(,]\s*\w+$", before) and re.match(r"\s*[,){]", after)):
                kind = "type"
            out.append((m[0], n, m.start() + 1, kind))
    if lang == "typescript":
        at = details.Text(text)
        out += [(name, at.line(x), at.column(x), "") for name, x in graphql_names(text)]
    return out


#: What reads the declarations of each language's files; a reader takes the text. Others may be added.
READERS = {"python": lambda text: python_decls(text), **{lang: (lambda text, lang=lang: brace_decls(text, lang)) for lang in BRACED}, **{lang: (lambda text, lang=lang: languages.read(text, lang)) for lang in ("java", "kotlin", "groovy", "c", "cpp", "sql", "xml", "markdown")}}


def declarations(text: str, lang: str) -> list[Decl]:
    """A file's declarations with their returns and annotations, none where the file can't be read."""
    try:
        found = READERS[lang](text) if lang in READERS else []
    except (SyntaxError, ValueError, RecursionError):
        return []
    if lang in ("markdown", "xml", "sql"):
        return list(found)
    whole, plain = details.Text(text), details.Text(plain_text(text, lang))
    out: list[Decl] = []
    for d in found:
        out += [d, *details.annotations(whole, plain, d, lang), *details.returns(plain, d, lang)]
    return out


def _decl_rows(path: str, text: str, lang: str) -> list[tuple]:
    whole = details.Text(text)
    found = declarations(text, lang)
    rows = []
    for at, (d, (sym, above)) in enumerate(zip(found, details.nested(found), strict=True)):
        span = None if d[1] in ("argument", "return", "annotation", "module") else details.comment_span(whole, d, lang)
        rows.append((path, sym, *d[1:], at, above, *(span or (None, None))))
    return rows


def _site_rows(path: str, text: str, lang: str) -> list[tuple]:
    """Sites that are no declarations, each with the innermost symbol around it and the position of a type."""
    found = declarations(text, lang)
    names = details.nested(found)
    declared = {(d[2], d[5], d[6]) for d in found if d[1] not in ("return", "annotation")}
    plain = details.Text(plain_text(text, lang))
    places = details.positions(plain, found, lang) if lang not in ("markdown", "xml", "sql") else []
    hosts = sorted(((d[3], -d[4], -len(d[0].split(".")), i) for i, d in enumerate(found) if d[1] not in ("argument", "return", "import", "module", "annotation")), reverse=True)
    # Outer symbols are written first, so each line ends up with its innermost.
    inner: dict[int, int] = {}
    for first, last, _, i in sorted(hosts, key=lambda h: (h[1] + h[0], -h[2], -h[3])):
        inner.update(dict.fromkeys(range(first, -last + 1), i))
    rows = []
    for name, line, col, kind in sites_of(text, lang):
        if (name, line, col) in declared:
            continue
        i = inner.get(line)
        host = (f"{found[i][1]} {names[i][0]}", names[i][0]) if i is not None else (None, "")
        rows.append((path, name, line, col, kind, details.position_of(places, plain.at(line, col)) if places else "", *host))
    return rows


def _parse(what: str):
    make, types, schema = (_site_rows, _SITE_TYPES, SITES) if what == "sites" else (_decl_rows, _DECL_TYPES, DECLS)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not lang or text is None or len(text) > MOST_BYTES or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
                    continue
                rows += make(path, text, lang)
                if len(rows) >= BATCH_ROWS:
                    yield arrow(rows)
                    rows = []
        if rows:
            yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def language(path: str = "path", extensions: dict[str, str] | None = None):
    """The language of a path's extension, or null; ``extensions`` add to those known or change them."""
    return F.create_map(*[F.lit(x) for kv in (EXTENSIONS | (extensions or {})).items() for x in kv])[F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))]


def clean_files(files: DataFrame) -> DataFrame:
    """(path, lang, clean) of files (path, content) in a known language: whether they have no fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            clean = [details.parses_cleanly(t or "", plain_text(t or "", lang), lang) for _, lang, t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.bool_())], ["path", "lang", "clean"])

    return files.select("path", language().alias("lang"), "content").where("lang is not null").mapInArrow(run, "path string, lang string, clean boolean")


def scan(spark: SparkSession, folder: str, ignore: list[str] | None = None, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(path, content) of the text files below a folder; noise folders, binary files and ignored paths are left out.

    ignore: patterns as in an ignore file, the later ones over the earlier (see ``ignored``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= MOST_BYTES)
    base = folder.split("://")[-1].rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    clean = files.where(~F.substring("content", 1, 8192).cast("string").contains("\x00"))
    rows = clean.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    parts = F.split("path", "/")
    rows = rows.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, noise))))
    return rows.where(~ignored(F.col("path"), ignore)) if ignore else rows


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over paths, whether it takes back) of a line of an ignore file; null for comments and empty lines."""
    line = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not line or line.startswith("#"):
        return None
    back, line = (True, line[1:]) if line.startswith("!") else (False, line)
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "[" and (shut := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : shut]
            out, i = out + f"[{'^' + inner[1:] if inner[0] == '!' else inner}]", shut + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i]))
            i += 1
    return f"{'^' if anchored else '^(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back


def ignored(path, patterns: list[str]):
    """Whether the last pattern that fits a path ignores it."""
    out = F.lit(False)
    for regex, back in filter(None, map(ignore_regex, patterns)):
        out = F.when(path.rlike(regex), F.lit(not back)).otherwise(out)
    return out


#: Goes into a parse cache's name: entries of another version aren't used.
CACHE_VERSION = 2


def parsed_rows(rows: DataFrame, what: str, cache: str | None = None) -> DataFrame:
    """Declarations or sites of files (path, lang, content); with a cache folder, only contents that it lacks are parsed, and added to it.

    An entry is named by path, language and the content's digest; the rows of a
    file without any are told by its key. Entries of contents that are gone stay
    until the folder's owner clears it.
    """
    schema = DECLS if what == "decls" else SITES
    if cache is None:
        return rows.where("lang is not null and content is not null").mapInArrow(_parse(what), schema)
    spark = rows.sparkSession
    place = f"{cache.rstrip('/')}/v{CACHE_VERSION}/{what}"
    keyed = rows.where("lang is not null").withColumn("digest", F.sha2(F.concat_ws("\x00", "path", "lang", "content"), 256))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/keys")
    known = spark.read.schema("digest string").parquet(f"{place}/keys") if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
    todo = keyed if known is None else keyed.join(known.distinct(), "digest", "left_anti")
    todo = written(todo.select("path", "lang", "content", "digest"))
    fresh = todo.select("path", "lang", "content").mapInArrow(_parse(what), schema).join(todo.select("path", "digest"), "path")
    fresh.write.mode("append").parquet(f"{place}/rows")
    todo.select("digest").distinct().write.mode("append").parquet(f"{place}/keys")  # after the rows, so a key means that they are there
    # A stop between the two leaves rows that are written again: told apart by nothing, they are one.
    stored = spark.read.schema(f"{schema}, digest string").parquet(f"{place}/rows")
    return stored.join(keyed.select("digest").distinct(), "digest", "left_semi").drop("digest").distinct()


def workspace(files: DataFrame, name: str = "workspace", definitions: DataFrame | None = None, implements: DataFrame | None = None, cache: str | None = None, extensions: dict[str, str] | None = None) -> LinkedWorkspace:
    """The tables over files (path, content).

    definitions (path, line, col, def_path, def_line), if any, settles ambiguous
    edges. implements (path, sym, of_path, of_sym), if any, says which types
    implement which; without it no ``.implements`` edge is known. cache: a folder
    that keeps what was parsed (see ``parsed_rows``); extensions: further ones.
    """
    spark = files.sparkSession
    # A path tells its language and all above it, so declarations need no join with their files.
    lang_of = language(extensions=extensions)
    rows = files.select("path", lang_of.alias("lang"), "content")
    decls = parsed_rows(rows, "decls", cache)
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    dir_ids = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.xxhash64(F.lit("dir"), F.array_join(F.slice(dirs, 1, n), "/")))
    dir_ids = F.when(F.size(dirs) > 0, dir_ids).otherwise(F.expr("cast(array() as array<bigint>)"))
    folders = F.concat(F.array(root()), dir_ids)
    above = rows.select("path", "lang", dirs.alias("dirs"), folders.alias("anc"))
    file = node_id("file", F.col("path"))
    none = F.lit(None)
    pick = ["id", "cls", "leaf", "full", "addr", "path", "lang", "parent", "anc", "file_id", "ord", "start", "end", "body_line", "comment_start", "comment_end", "sym"]
    f_rows = above.select(file.alias("id"), F.lit("file").alias("cls"), F.element_at(F.split("path", "/"), -1).alias("leaf"), F.element_at(F.split("path", "/"), -1).alias("full"), F.col("path").alias("addr"), "path", "lang", F.element_at("anc", -1).alias("parent"), F.concat("anc", F.array(file)).alias("anc"), file.alias("file_id"), F.col("path").alias("ord"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("int").alias("body_line"), none.cast("int").alias("comment_start"), none.cast("int").alias("comment_end"), F.lit("").alias("sym"))
    prefix = above.where(F.size("dirs") > 0).select("dirs", F.explode(F.sequence(F.lit(1), F.size("dirs"))).alias("n"), "anc").select(F.array_join(F.slice("dirs", 1, F.col("n")), "/").alias("path"), F.slice("anc", 1, F.col("n") + 1).alias("anc")).distinct()
    leaf = F.element_at(F.split("path", "/"), -1)
    d_rows = prefix.select(F.element_at("anc", -1).alias("id"), F.lit("dir").alias("cls"), leaf.alias("leaf"), leaf.alias("full"), F.col("path").alias("addr"), "path", none.cast("string").alias("lang"), F.element_at("anc", -2).alias("parent"), "anc", none.cast("long").alias("file_id"), F.col("path").alias("ord"), *[none.cast("int").alias(c) for c in ("start", "end", "body_line", "comment_start", "comment_end")], F.lit(None).cast("string").alias("sym"))
    symbol = lambda key: F.xxhash64(F.lit("symbol"), F.col("path"), key)
    placed = decls.where("path is not null").select("*", F.transform("above", symbol).alias("up"), lang_of.alias("lang"), F.concat(folders, F.array(file)).alias("fanc"))
    own = symbol(F.concat_ws(" ", "cls", "sym"))
    anc = F.concat("fanc", "up", F.array(own))
    s_rows = placed.select(own.alias("id"), "cls", "leaf", F.col("sym").alias("full"), F.concat("path", F.lit("#"), "sym").alias("addr"), "path", "lang", F.element_at(anc, -2).alias("parent"), anc.alias("anc"), file.alias("file_id"), F.concat_ws("\x01", "path", F.lpad(F.col("at").cast("string"), 8, "0")).alias("ord"), "start", "end", "body_line", "comment_start", "comment_end", "sym", "name_line", "name_col", F.col("above"))
    top = project(spark, name)
    top = top.select(*top.columns, *[none.cast("int").alias(c) for c in ("body_line", "comment_start", "comment_end")], none.cast("string").alias("sym"))
    nodes = top.select(pick).unionByName(d_rows.select(pick)).unionByName(f_rows.select(pick)).unionByName(s_rows.select(pick))

    def link() -> tuple[DataFrame, DataFrame, DataFrame | None]:
        edges, groups, stubs = _edges(parsed_rows(rows, "sites", cache), s_rows, definitions)
        if implements is not None:
            types = s_rows.where("cls not in ('argument', 'return', 'annotation', 'import')").select("id", "path", "sym")
            pairs = implements.join(types.toDF("src", "path", "sym"), ["path", "sym"]).join(types.toDF("dst", "of_path", "of_sym"), ["of_path", "of_sym"])
            pairs = pairs.select("src", "dst", F.lit("implements").alias("kind"), F.lit("").alias("pos"), F.lit("lsp").alias("conf"), F.lit("implements").alias("site")).distinct()
            edges = edges.unionByName(both_directions(pairs).withColumn("group", F.lit(None).cast("long")))
        if stubs is None:
            return edges, groups, None
        leaf = F.element_at(F.split("addr", "#"), -1)
        outer = stubs.select(node_id("external", F.col("addr")).alias("id"), F.lit("external").alias("cls"), leaf.alias("leaf"), leaf.alias("full"), "addr", none.cast("string").alias("path"), none.cast("string").alias("lang"), none.cast("long").alias("parent"), F.array(node_id("external", F.col("addr"))).alias("anc"), none.cast("long").alias("file_id"), F.concat(F.lit("\uffff"), "addr").alias("ord"), *[none.cast("int").alias(c) for c in ("start", "end", "body_line", "comment_start", "comment_end")], none.cast("string").alias("sym"))
        return edges, groups, outer

    made = LinkedWorkspace(nodes, split_lines(files, file, F.col("content")), link, definitions is not None, {"project": top.select(pick), "dir": d_rows.select(pick), "file": f_rows.select(pick), "": s_rows.select(pick)})
    made.texts = files.select(file.alias("file_id"), F.col("content").alias("text"))
    return made


#: Symbols whose own declarations are seen in their bodies only.
BODIES = ("func", "method", "ctor")


def _edges(sites: DataFrame, symbols: DataFrame, definitions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, groups, stubs) between the sites' innermost symbols and the declarations of their names.

    A declaration that any file may use is the far end of every site of its name.
    Neither side is multiplied out: a site has its name's declarations as a
    group, and a declaration its name's sites, by kind and position. Imports are
    seen in their own file, and what is declared in a body (arguments, inner
    functions) in that body and what it encloses; these are joined on file, name
    and owner, a site being dealt to each owner around it.

    Out edges name each candidate in scope, and are sure (lexical) if that is one.
    In edges test the declaration's own rule alone, and are sure if nothing else in
    the workspace has the name. A definition, if known, settles both: out edges
    keep the innermost candidate around it, in edges the declarations around it. If
    it lies outside the workspace, the out edge is ``external`` and ends at a stub.
    """
    src = F.when(F.col("host").isNotNull(), F.xxhash64(F.lit("symbol"), F.col("path"), F.col("host"))).otherwise(F.xxhash64(F.lit("file"), "path"))
    around = F.split("encl", r"\.")
    scopes = F.when(F.col("encl") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(around)), lambda n: F.array_join(F.slice(around, 1, n), "."))))
    site = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"), "name")
    near = sites.select("path", "name", "line", "col", "kind", "pos", src.alias("src"), site.alias("site"), scopes.alias("scopes"))
    body = F.try_element_at(F.filter("above", lambda x: F.substring_index(x, " ", 1).isin(*BODIES)), F.lit(-1))
    owner = F.when(body.isNotNull(), F.element_at(F.split(body, " ", 2), 2)).when(F.col("cls") == "import", F.lit(""))
    targets = symbols.where("cls not in ('module', 'return', 'annotation')")
    targets = targets.select(F.col("leaf").alias("name"), F.col("id").alias("dst"), F.col("path").alias("t_path"), owner.alias("scope"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    targets = written(targets)  # this and ``near`` are read by each kind of edge below, and parsed once
    local, everywhere = targets.where("scope is not null"), targets.where("scope is null")
    counted = targets.groupBy("name").agg(F.count(F.when(F.col("scope").isNull(), 1)).alias("n_any"), F.count(F.lit(1)).alias("n_all"))
    near = written(near).join(counted, "name")  # sites of names that nothing declares go
    if definitions is None:
        near = near.withColumns({"d_path": F.lit(None).cast("string"), "d_line": F.lit(None).cast("int")})
    else:
        defs = definitions.select("path", "line", "col", F.col("def_path").alias("d_path"), F.col("def_line").cast("int").alias("d_line")).dropDuplicates(["path", "line", "col"])
        near = near.join(defs, ["path", "line", "col"], "left")
    here = near.withColumn("scope", F.explode("scopes")).join(local.withColumnRenamed("t_path", "path"), ["path", "name", "scope"])
    here = written(here.select("src", "site", "name", "kind", "pos", "dst", "d_path", "n_all"))
    in_scope = here.groupBy("src", "site").agg(F.count(F.lit(1)).alias("n_here"))
    near = near.join(in_scope, ["src", "site"], "left").withColumn("n", F.col("n_any") + F.coalesce("n_here", F.lit(0)))
    near = written(near)  # with its counts
    # Each direction asks for a definition only where it has something to settle.
    for_out, for_in = (F.col("d_path").isNotNull() & (F.col(n) > 1) for n in ("n", "n_all"))
    here = here.join(near.select("src", "site", "n"), ["src", "site"])
    none, text = F.lit(None).cast("long"), F.col
    conf = lambda n: F.when(text(n) > 1, "unsettled").otherwise("lexical")
    own = ["kind", "pos"]
    out_id, in_id = node_id("out", F.col("src"), F.col("site")), node_id("in", F.col("dst"), F.col("src"), F.col("site"))

    def row(df: DataFrame, edge_id, direction: str, host: str, conf, far, group=none) -> DataFrame:
        return df.select(edge_id.alias("edge_id"), F.lit(direction).alias("dir"), F.col(host).alias("host"), *own, conf.alias("conf"), far.alias("far"), group.alias("group"))

    by_name, by_use = node_id("name", F.col("name")), node_id("use", F.col("name"), F.col("kind"), F.col("pos"))
    folded, uses = near.where(~for_out), near.where(~for_in)
    edges = [
        row(folded.where("n_any > 0"), out_id, "out", "src", conf("n"), none, by_name),
        row(here.where(~for_out), out_id, "out", "src", conf("n"), F.col("dst")),
        row(uses.select("name", "n_all", *own).distinct().join(everywhere, "name"), node_id("in", F.col("dst"), F.col("kind"), F.col("pos")), "in", "dst", conf("n_all"), none, by_use),
        row(here.where(~for_in), in_id, "in", "dst", conf("n_all"), F.col("src")),
    ]
    groups = everywhere.select(by_name.alias("group"), F.col("dst").alias("far"), F.lit("").alias("site")).union(uses.where("n_any > 0").select(by_use.alias("group"), "src", "site"))
    stubs = None
    if definitions is not None:
        known = near.where("d_path is not null")
        # A stub for what lies outside, by its package and name.
        stub = F.concat_ws("#", F.coalesce(external(F.col("d_path")), F.col("d_path")), "name")
        beyond = F.col("d_path").rlike(r"^(/|\.\.(/|$))")
        seen = known.join(targets, (known["name"] == targets["name"]) & (F.col("d_path") == F.col("t_path")) & F.col("d_line").between(F.col("t_start"), F.col("t_end"))).drop(targets["name"])
        seen = seen.where("scope is null or (path = t_path and array_contains(scopes, scope))")
        order = Window.partitionBy("src", "site").orderBy(F.col("t_end") - F.col("t_start"), F.col("t_start").desc(), "dst")
        picked = seen.where(for_out).withColumn("at", F.row_number().over(order)).where("at = 1")
        lost = known.where(for_out).join(picked.select("src", "site"), ["src", "site"], "left_anti")
        outside, unknown = lost.where(beyond), lost.where(~beyond)
        edges += [
            row(picked, out_id, "out", "src", F.lit("lsp"), F.col("dst")),
            row(seen.where(for_in), in_id, "in", "dst", F.lit("lsp"), F.col("src")),
            row(outside, out_id, "out", "src", F.lit("external"), node_id("external", stub)),
            row(unknown.where("n_any > 0"), out_id, "out", "src", F.lit("unsettled"), none, by_name),
            row(here.join(unknown.select("src", "site"), ["src", "site"], "left_semi"), out_id, "out", "src", F.lit("unsettled"), F.col("dst")),
        ]
        stubs = outside.select(stub.alias("addr")).distinct()
    return reduce(lambda a, b: a.unionByName(b), edges), groups, stubs


def external(path):
    """The package that a path outside the workspace belongs to, or null: module caches, node packages, site packages."""
    tries = [r"/pkg/mod/((?:[^/@]+/)*[^/@]+)@", r"/node_modules/((?:@[^/]+/)?[^/]+)", r"/site-packages/([^/]+)", r"/src/((?:[^/]+/)*)[^/]+$"]
    found = [F.nullif(F.regexp_replace(F.regexp_extract(path, t, 1), "/$|\\.py$", ""), F.lit("")) for t in tries]
    return F.coalesce(*found)


def collisions(ws: Workspace, base: int = 64, each: int = 4, most: int = 1500) -> DataFrame:
    """(names, lookups): how many names have two declarations or more, and how many definition lookups that allows."""
    named = ws.nodes.where("cls not in ('project', 'dir', 'file', 'argument', 'return', 'annotation', 'import', 'module')").groupBy("leaf").count().where("count >= 2")
    return named.agg(F.count(F.lit(1)).alias("names")).select("names", F.least(F.lit(base) + each * F.col("names"), F.lit(most)).alias("lookups"))
