"""Selector text to a small tree of dataclasses.

A list is alternatives; a complex is elements joined by descendant (space) or
child (>) steps; an element is a compound or a group with an optional range,
or a pseudo-element (::in, ::out, ::grep ...) hosted by what stands before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The tags a selector may name, and the axes of edges.
TAGS = frozenset("project dir file func method type struct interface class const var field enum ctor module import argument annotation return heading".split())
KINDS = frozenset("call type import implements".split())
POSITIONS = frozenset("return param field var".split())
# Language classes of code workspaces.
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "java": "java", "kt": "kotlin", "groovy": "groovy", "c": "c", "cpp": "cpp", "sql": "sql", "xml": "xml", "md": "markdown", "yaml": "yaml", "json": "json", "proto": "proto", "graphql": "graphql"}


class SelectorError(ValueError):
    """A selector that can't be read, with the place and what was expected."""


@dataclass
class Test:
    axis: str
    op: str
    value: str


@dataclass
class Bool:
    op: str  # and, or
    parts: list


@dataclass
class Pseudo:
    name: str
    arg: object = None


@dataclass
class Compound:
    tag: str | None = None
    self_ref: bool = False
    langs: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    tests: list = field(default_factory=list)
    pseudos: list[Pseudo] = field(default_factory=list)


@dataclass
class Edge:
    direction: str
    kinds: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    tests: list = field(default_factory=list)
    pseudos: list[Pseudo] = field(default_factory=list)


@dataclass
class Generated:
    name: str
    grep: Grep | None = None
    pseudos: list[Pseudo] = field(default_factory=list)


@dataclass
class Grep:
    pattern: str
    ignore_case: bool = False
    word: bool = False
    regex: bool = False
    invert: bool = False
    after: int = 0
    before: int = 0


@dataclass
class Element:
    body: Compound | Edge | Generated | list  # a list is a group: a chain of (combinator, Element)
    low: int = 1
    high: int | None = 1


#: (combinator, Element): "" hosts the element on what stands before, " " descends, ">" steps to a child, "&" stays.
Chain = list


_COLONS = re.compile(r"(?<![:\w]):{1,2}(any|all|empty|not|is|where|parents|has|in|out|grep|comment|signature|body|conflict|mine|theirs|base|first|last|root|contains|annotated|arity|recursive)\b")
_ELEMENTS = frozenset("in out grep comment signature body conflict mine theirs base".split())


def repaired(text: str) -> tuple[str, list[str]]:
    """A selector whose quotes a shell has taken apart, put together again, and notes on what was done.

    Quoted parts that touch each other, with or without an escaped quote between
    them, are one; a pattern that is quoted twice loses the inner quotes.
    """
    notes: list[str] = []

    def one(m: re.Match) -> str:
        parts = re.findall(r"'([^']*)'|\"([^\"]*)\"|\\(['\"])", m[0])
        inner = "".join(a or b or c for a, b, c in parts)
        if len(parts) > 1:
            notes.append(f"quoted parts joined to {inner!r}")
        bare = re.fullmatch(r"((?:-\w+\s+)*)([\"'])(.+)\2", inner)
        if bare and bare[2] not in bare[3]:
            inner = bare[1] + bare[3]
            notes.append(f"the inner quotes of {inner!r} taken off")
        if "'" in inner and '"' in inner:
            return m[0]
        return f'"{inner}"' if "'" in inner else f"'{inner}'"

    return re.sub(r"(?:'[^']*'|\"[^\"]*\")(?:\\['\"]|'[^']*'|\"[^\"]*\")*", one, text), notes


def normalise(text: str) -> str:
    """Colons repaired: pseudo-elements get two, pseudo-classes one; has is any."""
    parts = re.split(r"('(?:[^'])*'|\"(?:[^\"])*\")", text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r":{1,2}([a-z]+)\b", lambda m: ("::" if m[1] in _ELEMENTS else ":") + {"has": "any", "parent": "parents"}.get(m[1], m[1]), parts[i])
    return "".join(parts)


class _Reader:
    def __init__(self, text: str, languages: dict[str, str]):
        self.text, self.at, self.languages = text, 0, languages

    def fail(self, what: str):
        raise SelectorError(f"{what} at {self.at} in {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"expected {token!r}")

    def space(self) -> bool:
        start = self.at
        while self.peek().isspace():
            self.at += 1
        return self.at > start

    def match(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def quoted(self) -> str | None:
        if self.peek() not in ("'", '"'):
            return None
        quote = self.peek()
        end = self.text.find(quote, self.at + 1)
        if end < 0:
            self.fail("unclosed quote")
        out = self.text[self.at + 1 : end]
        self.at = end + 1
        return out

    def selector_list(self, relative: bool = False, stop: str = "") -> list[Chain]:
        out = []
        while True:
            self.space()
            out.append(self.chain(relative))
            self.space()
            if not self.take(","):
                break
        if stop and self.peek() != stop or not stop and self.at < len(self.text):
            self.fail("unexpected text")
        return out

    def chain(self, relative: bool, closing: str = "),") -> Chain:
        steps: Chain = []
        comb = " "
        if relative:
            if self.take(">"):
                comb = ">"
                self.space()
            elif self.take("&") or self.peek() == ":" and not self.text.startswith(":root", self.at):
                comb = "&"
        first = True
        while True:
            if self.peek(2) == "::":
                if not steps and comb != "&":
                    steps.append((comb, Element(Compound())))
                elif steps and comb in " >" and not first:
                    steps.append((comb, Element(Compound())))
                steps.append(("" if comb != "&" or steps else "&", self.pseudo_element()))
            elif self.take("("):
                self.space()
                inner = self.chain(False)
                self.space()
                self.need(")")
                steps.append((comb, Element(inner, *self.range())))
            else:
                steps.append((comb, self.compound(comb == "&")))
            while self.peek(2) == "::":
                steps.append(("", self.pseudo_element()))
            first = False
            gap = self.space()
            if self.take(">"):
                self.space()
                comb = ">"
            elif gap and self.peek() and self.peek() not in closing:
                comb = " "
            else:
                return steps

    def range(self) -> tuple[int, int | None]:
        m = re.compile(r"\{(\d+)(,)?(\d+)?\}|\((\d+)(,)?(\d+)?\)").match(self.text, self.at)
        if not m:
            return 1, 1
        self.at = m.end()
        first, comma, last = m.groups()[:3] if m[1] else m.groups()[3:]
        low = int(first)
        high = int(last) if last else None if comma else low
        if high is not None and high < low:
            self.fail("a range ends before it begins")
        return low, high

    def compound(self, self_ref: bool = False) -> Element:
        c = Compound(self_ref=self_ref)
        start = self.at
        if self.take("&"):
            c.self_ref = True
        elif not self.take("*"):
            m = re.compile(r"(?:(name|path)(~=|\^=|\$=|\*=|=))").match(self.text, self.at)
            if m:
                c.tests.append(self.test())
            elif m := re.compile(r"([\w./-]+\.\w+)#").match(self.text, self.at):
                c.ids.append(m[1] + "#" + (self.at_set(m.end()) or self.name()))
            elif word := self.match(r"[a-z]+"):
                if word not in TAGS:
                    near = min(TAGS, key=lambda t: (_distance(t, word), t))
                    self.fail(f"no tag {word!r}; did you mean {near!r}?")
                c.tag = word
        while True:
            if self.take("."):
                lang = self.match(r"[A-Za-z]+") or self.fail("expected a language")
                if lang not in self.languages:
                    self.fail(f"no language {lang!r}")
                c.langs.append(self.languages[lang])
            elif self.take("#"):
                c.ids.append(self.name())
            elif self.take("["):
                c.tests.append(self.tests("]"))
                self.need("]")
            elif self.peek() == ":" and self.peek(2) != "::":
                c.pseudos.append(self.pseudo())
            else:
                break
        if self.at == start and not self_ref:
            self.fail("expected a selector")
        if sum(p.name in ("first", "last") for p in c.pseudos) > 1:
            self.fail("only one of :first and :last")
        return Element(c, *self.range())

    def at_set(self, at: int) -> str:
        self.at = at
        return ""

    def name(self) -> str:
        got = self.quoted()
        return got if got is not None else self.match(r"[\w.\-/]+") or self.fail("expected a name")

    def test(self) -> Test:
        axis = self.match(r"name|path") or self.fail("expected name or path")
        op = self.match(r"~=|\^=|\$=|\*=|=") or self.fail("expected an operator")
        value = self.quoted()
        if value is None:
            value = self.match(r"[^\s,>:\]|&()]+") or self.fail("expected a value")
        return Test(axis, op, value)

    def tests(self, stop: str):
        """Or of ands of tests and groups."""
        ors = []
        while True:
            ands = []
            while True:
                self.space()
                if self.take("("):
                    ands.append(self.tests(")"))
                    self.need(")")
                else:
                    ands.append(self.test())
                self.space()
                if not self.take("&"):
                    break
            ors.append(ands[0] if len(ands) == 1 else Bool("and", ands))
            if not self.take("|"):
                break
        return ors[0] if len(ors) == 1 else Bool("or", ors)

    def pseudo(self) -> Pseudo:
        self.need(":")
        name = self.match(r"[a-z]+") or self.fail("expected a pseudo-class")
        if name in ("root", "first", "last", "recursive"):
            return Pseudo(name)
        if name in ("where", "any", "all", "empty", "not", "is", "parents"):
            if not self.take("("):
                if name in ("where", "not", "is"):
                    self.fail(f":{name} needs a selector")
                return Pseudo(name)
            arg = self.selector_list(name in ("where", "any", "all", "empty"), ")")
            self.need(")")
            return Pseudo(name, arg)
        if name in ("contains", "annotated"):
            self.need("(")
            out = Pseudo(name, self.grep())
            self.need(")")
            return out
        if name == "arity":
            self.need("(")
            low = int(self.match(r"\d+") or self.fail("expected a number"))
            high: int | None = low
            if self.take(","):
                more = self.match(r"\d+")
                high = int(more) if more else None
            self.need(")")
            return Pseudo(name, (low, high))
        return self.fail(f"no pseudo-class :{name}")

    def grep(self, context: bool = False) -> Grep:
        raw = self.quoted()
        if raw is None:
            self.fail("expected a quoted pattern")
        g = Grep("")
        fixed = False
        rest = raw
        while m := re.match(r"-([iwEFvn]+|[ABC]\s*\d+)(?:\s+|$)", rest):
            flag = m[1]
            if flag[0] in "ABC":
                if not context:
                    self.fail("context lines only in ::grep")
                n = int(flag[1:])
                g.after = n if flag[0] in "AC" else g.after
                g.before = n if flag[0] in "BC" else g.before
            else:
                g.ignore_case |= "i" in flag
                g.word |= "w" in flag
                g.regex |= "E" in flag
                g.invert |= "v" in flag
                fixed |= "F" in flag
            rest = rest[m.end() :]
        if g.regex and fixed:
            self.fail("-E and -F exclude each other")
        g.pattern = rest
        return g

    def pseudo_element(self) -> Element:
        self.need("::")
        name = self.match(r"[a-z]+") or self.fail("expected a pseudo-element")
        if name in ("in", "out"):
            e = Edge(name)
            while True:
                if self.take("."):
                    kind = self.match(r"[a-z]+")
                    if kind not in KINDS | POSITIONS:
                        self.fail(f"no edge kind {kind!r}")
                    e.kinds.append(kind)
                elif self.take("#"):
                    e.ids.append(self.name())
                elif self.take("["):
                    e.tests.append(self.tests("]"))
                    self.need("]")
                elif self.peek() == ":" and self.peek(2) != "::":
                    e.pseudos.append(self.pseudo())
                else:
                    break
            low, high = self.range()
            if low < 1:
                self.fail("an edge is crossed once at least")
            return Element(e, low, high)
        if name in ("grep", "comment", "signature", "body", "conflict", "mine", "theirs", "base"):
            g = Generated(name)
            if name == "grep":
                g.grep = Grep(".*", regex=True)
                if self.take("("):
                    g.grep = self.grep(True)
                    self.need(")")
            while self.peek() == ":" and self.peek(2) != "::":
                g.pseudos.append(self.pseudo())
            return Element(g)
        return self.fail(f"no pseudo-element ::{name}")


def _distance(a: str, b: str) -> int:
    """Edit distance less twice the common prefix, without case."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    prefix = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return row[-1] - 2 * prefix


def parse(text: str, languages: dict[str, str] | None = None) -> list[Chain]:
    """The alternatives of a selector list."""
    if not text.strip():
        raise SelectorError("an empty selector")
    return _Reader(normalise(repaired(text.strip())[0]), LANGUAGES if languages is None else languages).selector_list()
