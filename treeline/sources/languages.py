"""Declarations of Java, Kotlin, Groovy, C, C++, SQL, XML and Markdown files, each by a scan without a grammar.

All functions give (sym, class, leaf, start, end, name line, name column, body
line) tuples; lines and columns count from 1. Broken files give what could be read.
"""

from __future__ import annotations

import re
from xml.parsers import expat

Decl = tuple

_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s{0,3}(?:```+|~~~+)")


def markdown_decls(text: str) -> list[Decl]:
    """Headed sections, nested by level; fenced code holds no headings."""
    lines, open_, out, fenced = text.rstrip("\n").split("\n"), [], [], False

    def close(level: int, before: int) -> None:
        while open_ and open_[-1][0] >= level:
            _, sym, leaf, at, column = open_.pop()
            out.append((sym, "heading", leaf, at, before, at, column, at))

    for n, line in enumerate(lines, 1):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(line)) and m[2]:
            close(len(m[1]), n - 1)
            open_.append((len(m[1]), f"{open_[-1][1]}.{m[2]}" if open_ else m[2], m[2], n, m.start(2) + 1))
    close(0, len(lines))
    return sorted(out, key=lambda d: d[3])


def markdown_names(text: str) -> list[tuple[str, int, int]]:
    """(name, line, column) of identifiers in headings, fenced code and code spans; prose isn't indexed."""
    out, fenced = [], False
    for n, line in enumerate(text.split("\n"), 1):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        head = None if fenced else _HEADING.match(line)
        spans = [(0, len(line))] if fenced else [head.span(2)] if head else [m.span(1) for m in re.finditer(r"`+([^`\n]+)`+", line)]
        out += [(m[0], n, m.start() + 1) for a, b in spans for m in re.compile(r"[A-Za-z_]\w*", re.A).finditer(line, a, b)]
    return out


def xml_decls(text: str) -> list[Decl]:
    """Elements that declare a name: @+type/x as field, name or key attributes as const; under the nearest named ancestor."""
    out: list[Decl] = []
    stack: list[tuple | None] = []
    raw = text.encode()
    parser = expat.ParserCreate("utf-8")

    def start(_tag: str, attributes: dict[str, str]) -> None:
        found = None
        for key, value in attributes.items():
            value = value.strip()
            resource = re.fullmatch(r"@\+(?:[\w.]+:)?\w+/([\w.]+)", value)
            if found is None and key.split(":")[-1] in ("name", "key") and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", value):
                found = value, "const"
            elif found is None and resource:
                found = resource[1], "field"
        if found:
            at = raw.find(found[0].encode(), parser.CurrentByteIndex)
            line = raw.count(b"\n", 0, at) + 1
            found = (*found, parser.CurrentLineNumber, line, at - (raw.rfind(b"\n", 0, at) + 1) + 1)
        stack.append(found)

    def end(_tag: str) -> None:
        if found := stack.pop():
            name, cls, first, line, column = found
            above = next((s[0] for s in reversed(stack) if s), None)
            out.append((f"{above}.{name}" if above else name, cls, name, first, parser.CurrentLineNumber, line, column, 0))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        pass  # what was read before the fault stays
    return sorted(out, key=lambda d: (d[3], d[6]))


def blank(text: str, sql: bool = False) -> str:
    """Comments and quoted text as spaces, line feeds kept."""
    comment = r"--[^\n]*" if sql else r"//[^\n]*"
    quoted = r"'(?:''|[^'])*'" if sql else r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    return re.sub(rf"{comment}|/\*.*?\*/|{quoted}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


class _Places:
    def __init__(self, text: str):
        self.text = text

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def column(self, at: int) -> int:
        return at - (self.text.rfind("\n", 0, at) + 1) + 1


_SQL = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|temporary\s+|temp\s+|materialized\s+)*(?P<what>table|view|function|procedure|index|type|trigger|sequence)\s+(?:if\s+not\s+exists\s+)?(?:[\w\"]+\.)?\"?(?P<name>\w+)\"?", re.I)
# First words of a table's parts that are no columns.
_CONSTRAINTS = frozenset("primary foreign unique check constraint exclude index key like".split())


def sql_decls(text: str) -> list[Decl]:
    """Tables as struct with their columns as field, functions as func, all other kinds as type."""
    plain = blank(text, sql=True)
    at, out = _Places(plain), []
    for m in _SQL.finditer(plain):
        what = m["what"].lower()
        stop = plain.find(";", m.end())
        stop = len(plain) - 1 if stop < 0 else stop
        cls = {"table": "struct", "function": "func", "procedure": "func"}.get(what, "type")
        out.append((m["name"], cls, m["name"], at.line(m.start()), at.line(stop), at.line(m.start("name")), at.column(m.start("name")), 0))
        if what == "table" and (open_ := plain.find("(", m.end(), stop)) >= 0:
            depth, first = 0, open_ + 1
            for i in range(open_, stop + 1):
                depth += (plain[i] == "(") - (plain[i] == ")")
                if depth == 0 or depth == 1 and plain[i] == ",":
                    c = re.match(r"\s*\"?(\w+)", plain[first:i])
                    if c and c[1].lower() not in _CONSTRAINTS:
                        name_at = first + c.start(1)
                        out.append((f"{m['name']}.{c[1]}", "field", c[1], at.line(name_at), at.line(i), at.line(name_at), at.column(name_at), 0))
                    first = i + 1
                if depth == 0:
                    break
    return out


_CONTAINER = re.compile(r"\b(?P<form>data\s+class|enum\s+class|enum\s+struct|@interface|class|interface|enum|record|struct|union|namespace|object|trait)\s+(?P<name>\w+)")
_CALLABLE = re.compile(r"(?P<name>~?[A-Za-z_]\w*)\s*\((?P<args>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:(?:const|override|noexcept|final|throws\s+[\w.,\s]+|->\s*[\w:<>*&\s]+|:\s*[\w.<>?,\s\[\]&*():]+|=.*)\s*)*$", re.S)
_VALUE = re.compile(r"(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?::\s*[\w.<>?,\s]+)?(?:=.*)?$", re.S)
# Words that open statements, never declarations.
_STATEMENTS = frozenset("if for while switch catch return new else do try throw case synchronized assert using goto delete when".split())
# What each form of container counts as.
_FORMS = {"data class": "struct", "record": "struct", "struct": "struct", "union": "struct", "interface": "interface", "@interface": "interface", "trait": "interface", "enum": "enum", "enum class": "enum", "enum struct": "enum", "namespace": "module"}


def curly_decls(text: str, lang: str) -> list[Decl]:
    """Containers, callables with arguments, fields and variables of Java, Kotlin, Groovy, C and C++."""
    plain = re.sub(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", lambda m: re.sub(r"[^\n]", " ", m[0]), blank(text), flags=re.M) if lang in ("c", "cpp") else blank(text)
    at, out = _Places(plain), []
    # Inside a container: (name, form). Inside anything else: None.
    stack: list[tuple | None] = []
    parens, first = 0, 0
    newline_ends = lang in ("kotlin", "groovy")

    def declare(head: str, head_at: int, brace: int | None, stop: int) -> tuple | None:
        """Adds what the head declares; what the brace after it opens, if it is a container."""
        lead = len(head) - len(head.lstrip())
        head, head_at = head.strip(), head_at + lead
        if not head or stack and stack[-1] is None:
            return None
        prefix = ".".join(s[0] for s in stack if s)
        line = lambda x: at.line(x)

        def add(name: str, cls: str, name_at: int, sym: str | None = None, end: int | None = None, start: int | None = None) -> int:
            sym = sym or (f"{prefix}.{name}" if prefix else name)
            out.append([sym, cls, name, line(head_at if start is None else start), line(stop if end is None else end), line(name_at), at.column(name_at), line(brace) if brace is not None and start is None else 0])
            return len(out) - 1

        clean = re.sub(r"@\w+(?:\.\w+)*(?:\([^()]*\))?", lambda m: m[0] if m[0] == "@interface" else " " * len(m[0]), head)
        word = re.match(r"\w*", clean.lstrip())[0]
        if word in _STATEMENTS and not (lang == "cpp" and word == "using"):
            return None
        if word in ("import", "package", "using"):
            if m := re.search(r"([\w*]+)\s*$", re.sub(r"\s+as\s+", " ", clean)):
                if m[1] != "*":
                    add(m[1], "module" if word == "package" else "import", head_at + m.start(1), sym=m[1])
            return None
        if m := re.match(r"(?:typedef\b.*\b(\w+)$|typealias\s+(\w+))", clean, re.S):
            g = 1 if m[1] else 2
            add(m[g], "type", head_at + m.start(g))
            return None
        if (m := _CONTAINER.search(clean)) and (brace is not None or lang in ("kotlin", "java") and "(" in clean):
            if "(" not in clean[: m.start()] and "=" not in clean[: m.start()]:
                form = re.sub(r"\s+", " ", m["form"])
                cls = "interface" if re.search(r"\bannotation\s+$", clean[: m.start()]) else _FORMS.get(form, "class")
                place = add(m["name"], cls, head_at + m.start("name"))
                return m["name"], cls, place
        owner = next((s for s in reversed(stack) if s and s[1] != "module"), None)
        if (m := _CALLABLE.search(clean)) and "=" not in clean[: m.start()].replace("==", ""):
            before = clean[: m.start()].rstrip()
            name = m["name"].lstrip("~")
            ctor = owner and name == owner[0] or before.endswith("::") and re.search(rf"\b{name}::$", before)
            body = brace is not None or lang == "kotlin" and re.search(r"\bfun\b", before)
            if name in _STATEMENTS or not (before or ctor) or not (body or owner):
                return None
            qualifier = re.search(r"(\w+)(?:<[^<>]*>)?(?:::|\.)$", before) if lang in ("cpp", "kotlin") else None
            sym = f"{qualifier[1]}.{name}" if qualifier else None
            add(name, "ctor" if ctor else "method" if owner or qualifier else "func", head_at + m.start("name"), sym=sym)
            whole = out[-1][0]
            offset = head_at + m.start("args")
            for part in re.split(r",(?![^(<]*[)>])", m["args"]):
                a = re.match(r"\s*(?:vararg\s+)?(\w+)\s*:", part) if lang == "kotlin" else re.search(r"\w[\s*&>\]]+(\w+)\s*(?:\[\s*\])?\s*(?:=.*)?$", part.rstrip()) or (re.match(r"\s*(\w+)\s*(?:=.*)?$", part) if lang == "groovy" else None)
                if a:
                    add(a[1], "argument", offset + a.start(1), sym=f"{whole}.{a[1]}", end=offset + len(part) - 1, start=offset + a.start(1))
                offset += len(part) + 1
            return None
        if (m := _VALUE.search(clean)) and (owner or len(stack) == sum(s is not None for s in stack)) and brace is None:
            typed = clean[: m.start()].strip()
            if typed and not re.search(r"[(=]", typed):
                fixed = re.search(r"\bconst\b|\bval\b" if lang in ("kotlin", "cpp", "c") else r"\bconst\b", typed)
                add(m["name"], "field" if owner else "const" if fixed else "var", head_at + m.start("name"))
        return None

    def constants(segment: str, segment_at: int) -> None:
        """The names of an enum's list, once: what comes after its first end isn't in the list."""
        if not stack or stack[-1] is None or stack[-1][1] != "enum" or stack[-1][0] in listed:
            return
        listed.add(stack[-1][0])
        prefix = ".".join(s[0] for s in stack if s)
        for part in re.finditer(r"(?:^|,)\s*(?:@\w+\s+)*(\w+)(?:\s*\([^()]*\))?(?:\s*=[^,]*)?", segment):
            name_at = segment_at + part.start(1)
            out.append([f"{prefix}.{part[1]}", "const", part[1], at.line(name_at), at.line(segment_at + part.end() - 1), at.line(name_at), at.column(name_at), 0])

    listed: set[str] = set()
    opened: list[int | None] = []
    for i, c in enumerate(plain):
        if c in "([":
            parens += 1
        elif c in ")]":
            parens = max(0, parens - 1)
        elif parens:
            continue
        elif c == "{":
            size = len(out)
            inner = declare(plain[first:i], first, i, i)
            opened.append(inner[2] if inner else size if len(out) > size else None)
            stack.append(inner[:2] if inner else None)
            first = i + 1
        elif c == "}":
            constants(plain[first:i], first)
            if stack:
                stack.pop()
                if (place := opened.pop()) is not None:
                    out[place][4] = at.line(i)
            first = i + 1
        elif c == ";" or c == "\n" and newline_ends and plain[first:i].strip():
            if c == ";" and stack and stack[-1] and stack[-1][1] == "enum" and stack[-1][0] not in listed:
                constants(plain[first:i], first)
            elif not (c == "\n" and stack and stack[-1] and stack[-1][1] == "enum" and stack[-1][0] not in listed):
                declare(plain[first:i], first, None, i)
            else:
                continue
            first = i + 1
    if newline_ends:
        declare(plain[first:], first, None, len(plain) - 1)
    return sorted(map(tuple, out), key=lambda d: (d[3], d[6]))


def read(text: str, lang: str) -> list[Decl]:
    if lang == "markdown":
        return markdown_decls(text)
    if lang == "xml":
        return xml_decls(text)
    return sql_decls(text) if lang == "sql" else curly_decls(text, lang)
