"""What surrounds declarations: returns, annotations, doc comments, positions of types, nesting with ordinals.

Everything works on a file's text and its flat declarations (sym, class, leaf,
start, end, name line, name column, body line); lines and columns count from 1.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from xml.parsers import expat

Decl = tuple
CALLABLES = ("func", "method", "ctor")
_TYPES_AFTER = ("go", "typescript", "python", "kotlin")
_ALONE = re.compile(r"\s*@[\w.]+(?:\(.*\))?\s*$")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
# Words before a declared name that are no type.
_MODIFIERS = frozenset("public private protected static final abstract synchronized native default override open internal inline virtual explicit extern unsigned signed const constexpr volatile register async export suspend def void fun func function operator friend typename".split())
# How a line of comment begins, by language; others as in C.
_COMMENT = {lang: re.compile(rf"\s*(?:{x})") for lang, x in {"python": r"#", "sql": r"--|/\*|\*", "xml": r"<!--", "markdown": r"<!--", "": r"//|/[*]|[*]"}.items()}
_PAIRS = {pair: re.compile("[" + re.escape(pair) + "]") for pair in ("()", "{}", "[]", "<>")}


class Text:
    """A text with its line starts."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, line: int, column: int = 1) -> int:
        return self.starts[min(line, len(self.starts)) - 1] + column - 1 if line <= len(self.starts) else len(self.text)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1

    def row(self, line: int) -> str:
        return self.text[self.at(line) : self.at(line + 1)].rstrip("\n")


def closing(text: str, at: int, pair: str) -> int:
    """Place of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in _PAIRS[pair].finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def header(plain: Text, d: Decl, lang: str) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Ranges of a callable's parameters and of its result type in a text without comments and strings."""
    name = plain.at(d[5], d[6])
    stop = plain.at(d[4] + 1)
    open_ = plain.text.find("(", name, stop)
    if open_ < 0:
        return None
    shut = closing(plain.text, open_, "()")
    if lang not in _TYPES_AFTER:
        return (open_ + 1, shut), (plain.at(d[3]), name)
    tail = shut + 1
    if lang == "python":
        m = re.compile(r"\s*->\s*").match(plain.text, tail)
        end = plain.text.find(":\n", tail, stop) if m else -1
        return (open_ + 1, shut), (m.end(), end if end >= 0 else plain.at(plain.line(tail) + 1) - 1) if m else (tail, tail)
    if lang != "go":
        m = re.compile(r"\s*:\s*").match(plain.text, tail)
        if not m:
            return (open_ + 1, shut), (tail, tail)
        tail = m.end()
    depth, end = 0, tail
    while end < min(stop, len(plain.text)):
        c = plain.text[end]
        if c in "([<":
            depth += 1
        elif c in ")]>":
            depth -= 1
        elif c == "{" and re.search(r"\b(?:interface|struct)\s*$", plain.text[tail:end]):
            end = closing(plain.text, end, "{}")
        elif depth <= 0 and (c in "{;=" or c == "\n"):
            break
        end += 1
    return (open_ + 1, shut), (tail, end)


def _parts(text: str, at: int) -> list[tuple[str, int]]:
    """What commas outside brackets separate, with places."""
    out, depth, first = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append((text[first:i], at + first))
            first = i + 1
    return out


def returns(plain: Text, d: Decl, lang: str) -> list[Decl]:
    """A node for each result type of a callable; the leaf is the type's own name."""
    if d[1] not in ("func", "method") or not (found := header(plain, d, lang)):
        return []
    a, b = found[1]
    text = plain.text[a:b]
    if lang == "go" and text.strip().startswith("("):
        a += text.index("(") + 1
        text = text.strip()[1:].rstrip()[:-1]
        parts = _parts(text, a)
    elif lang in _TYPES_AFTER:
        parts = [(text, a)]
    else:
        text = re.sub(r"@\w+(?:\.\w+)*(?:\([^()]*\))?", lambda m: " " * len(m[0]), text)
        parts = [(re.sub(r"\b\w+\b", lambda m: " " * len(m[0]) if m[0] in _MODIFIERS else m[0], text), a)]
    out = []
    for part, at in parts:
        bare = re.sub(r"[<\[](?:[^<>\[\]]|[<\[][^<>\[\]]*[>\]])*[>\]]", lambda m: " " * len(m[0]), part)
        words = [m for m in _NAME.finditer(bare) if lang == "typescript" or m[0] not in ("map", "chan", "interface", "struct")]
        if not words:
            words = list(_NAME.finditer(part))
        if words:
            m = words[-1]
            place = at + m.start()
            out.append((f"{d[0]}.{m[0]}", "return", m[0], plain.line(at + len(part) - len(part.lstrip())), plain.line(max(at, at + len(part.rstrip()) - 1)), plain.line(place), plain.column(place), 0))
    return out


def annotations(text: Text, plain: Text, d: Decl, lang: str) -> list[Decl]:
    """A node for each annotation or decorator of a declaration, and for each key of a Go field's tag."""
    out = []

    def add(name: str, at: int) -> None:
        out.append((f"{d[0]}.{name}", "annotation", name, text.line(at), text.line(at), text.line(at), text.column(at), 0))

    if lang == "go":
        if d[1] == "field" and (tag := re.search(r"`([^`\n]*)`", text.row(d[3]))):
            for m in re.finditer(r"(\w+):\"", tag[1]):
                add(m[1], text.at(d[3], tag.start(1) + m.start(1) + 1))
        return out
    if lang not in ("python", "typescript", "java", "kotlin", "groovy") or d[1] in ("argument", "import", "module"):
        return out
    first = d[3]
    while first > 1 and _ALONE.match(text.row(first - 1)):
        first -= 1
    for m in re.compile(r"@(?!interface\b)(?:\w+\.)*(\w+)").finditer(plain.text, plain.at(first), plain.at(d[5], d[6])):
        add(m[1], m.start(1))
    return out


def comment_span(text: Text, d: Decl, lang: str) -> tuple[int, int] | None:
    """Lines of the run of comments that touches a declaration from above, else the line of a comment behind its head."""
    begins = _COMMENT.get(lang, _COMMENT[""])
    first = d[3]
    while first > 1 and _ALONE.match(text.row(first - 1)):
        first -= 1
    low = first
    while low > 1:
        row = text.row(low - 1)
        if begins.match(row):
            low -= 1
        elif lang not in ("python",) and row.rstrip().endswith(("*/", "-->")):
            back = low - 1
            while back > 1 and not re.search(r"/\*|<!--", text.row(back)):
                back -= 1
            if not re.match(r"\s*(?:/\*|<!--)", text.row(back)):
                break
            low = back
        else:
            break
    if low < first:
        return low, first - 1
    tail = text.row(d[3])[d[6] - 1 if d[5] == d[3] else 0 :]
    mark = {"python": r"#", "sql": r"--", "xml": r"<!--", "markdown": r"<!--"}.get(lang, r"//|/\*")
    quoted = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: " " * len(m[0]), tail)
    return (d[3], d[3]) if re.search(mark, quoted) else None


def positions(plain: Text, decls: list[Decl], lang: str) -> list[tuple[int, int, str]]:
    """(from, to, position) of the places where a type is a parameter's, a result's, a field's or a variable's; later ones are inside earlier ones."""
    out = []
    for d in decls:
        if d[1] in ("field", "var", "const"):
            out.append((plain.at(d[3]), plain.at(d[4] + 1), "field" if d[1] == "field" else "var"))
        elif d[1] in CALLABLES and (found := header(plain, d, lang)):
            out += [(*found[0], "param"), (*found[1], "return")]
    return out


def position_of(places: list[tuple[int, int, str]], at: int) -> str:
    inside = [p for p in places if p[0] <= at < p[1]]
    return min(inside, key=lambda p: p[1] - p[0])[2] if inside else ""


def nested(decls: list[Decl]) -> list[tuple[str, list[str]]]:
    """(name, keys above) of each declaration, in their order.

    A declaration lies under the nearest one that its dotted name leads to; of
    several of that name under the one whose lines hold it. What has the same
    parent, class and name is numbered, and what lies below has the number in its
    name. A key is the class and the name.
    """
    by_sym: dict[str, list[int]] = {}
    for i, d in enumerate(decls):
        if d[1] not in ("argument", "return", "annotation", "import"):
            by_sym.setdefault(d[0], []).append(i)
    above: list[int | None] = []
    for i, d in enumerate(decls):
        head, found = d[0], None
        while "." in head and found is None:
            head = head.rpartition(".")[0]
            same = [j for j in by_sym.get(head, ()) if j != i]
            holds = [j for j in same if decls[j][3] <= d[3] and d[4] <= decls[j][4]]
            # The last to begin is the innermost; of one line's, the last before it.
            before = [j for j in holds if (decls[j][5], decls[j][6]) <= (d[5], d[6])]
            found = max(before or holds, key=lambda j: (decls[j][3], decls[j][5], decls[j][6]), default=same[0] if same else None)
        above.append(found)
    order = sorted(range(len(decls)), key=lambda i: (decls[i][0].count("."), i))
    total: dict[tuple, int] = {}
    tail = {}
    for i, d in enumerate(decls):
        parent = decls[above[i]][0] if above[i] is not None else None
        tail[i] = d[0][len(parent) + 1 :] if parent is not None else d[0]
        total[above[i], d[1], tail[i]] = total.get((above[i], d[1], tail[i]), 0) + 1
    seen: dict[tuple, int] = {}
    out: list[tuple[str, list[str]]] = [("", [])] * len(decls)
    for i in order:
        k = above[i], decls[i][1], tail[i]
        seen[k] = seen.get(k, 0) + 1
        name = f"{tail[i]}[{seen[k]}]" if total[k] > 1 else tail[i]
        if above[i] is None:
            out[i] = name, []
        else:
            up, keys = out[above[i]]
            out[i] = f"{up}.{name}", [*keys, f"{decls[above[i]][1]} {up}"]
    return out


def parses_cleanly(text: str, plain: str, lang: str) -> bool:
    """Whether a file has no fault: Python and XML by their parsers, others by their brackets."""
    if lang == "python":
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True
    if lang == "xml":
        try:
            expat.ParserCreate("utf-8").Parse(text.encode(), True)
        except expat.ExpatError:
            return False
        return True
    if lang == "markdown":
        return True
    open_: list[str] = []
    for c in plain:
        if c in "([{":
            open_.append(c)
        elif c in ")]}" and (not open_ or "([{".index(open_.pop()) != ")]}".index(c)):
            return False
    return not open_
