"""Line patterns: one Java regular expression for a grep's flags, with RE2's meaning.

A pattern is read token by token. What RE2 refuses is refused here, before any
job: backreferences, lookaround, possessive quantifiers, atomic groups, unknown
escapes. What both write but mean differently is rewritten: white space, word
edges, the end of the text, ``.`` beside other line ends, classes in classes,
scripts, named groups, and case, which is Unicode's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from treeline.plans.selector import Grep, SelectorError

# POSIX classes as ranges.
_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "blank": r" \t", "cntrl": r"\x00-\x1F\x7F", "graph": "!-~", "print": " -~", "ascii": r"\x00-\x7F"}
_PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_INNER = r"(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int]:
    """Java's form of the escape at a backslash, and where it ends."""
    c = pattern[at + 1 : at + 2]
    if c.lower() in _PERL and c:
        ranges = _PERL[c.lower()]
        return (ranges if inside and c.islower() else f"[{'^' if c.isupper() else ''}{ranges}]"), at + 2
    if m := re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))").match(pattern, at):
        name = m[3] or m[4]
        negated = (m[1] == "P") != bool(m[2])
        return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}", m.end()
    if m := re.compile(r"\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|\\0[0-7]{0,2}").match(pattern, at):
        return (m[0] if m[0] != "\\0" else "\\x00"), m.end()
    if c in "aftnr" and c:
        return f"\\{c}", at + 2
    if c == "v":
        return r"\x0B", at + 2
    if not inside and c in "bBAz" and c:
        return {"b": _EDGE, "B": _INNER, "A": r"\A", "z": r"\z"}[c], at + 2
    if not inside and c == "Q":
        stop = pattern.find("\\E", at)
        stop = len(pattern) if stop < 0 else stop
        return "".join(_literal(x) for x in pattern[at + 2 : stop]), stop + 2
    if c and (not c.isalnum() or not c.isascii()):
        return _literal(c), at + 2
    raise SelectorError(f"\\{c} isn't supported: {pattern!r}")


def _literal(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c


def _class(pattern: str, at: int) -> tuple[str, int]:
    """Java's form of the class at a bracket, and where it ends."""
    out, i = "[", at + 1
    if pattern[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i):
            if m[2] not in _POSIX:
                raise SelectorError(f"no class [:{m[2]}:]: {pattern!r}")
            out, i = out + (f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]), m.end()
        elif c == "\\":
            piece, i = _escape(pattern, i, True)
            out += piece
        else:
            out, i = out + ("\\" + c if c in "[]&^" else c), i + 1
    raise SelectorError(f"a class isn't closed: {pattern!r}")


def to_java(pattern: str) -> str:
    """A linear-time pattern in Java's dialect."""
    out, i, depth = "", 0, 0
    quantified = begun = False
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern)
    while i < len(pattern):
        c = pattern[i]
        was, quantified = quantified, False
        fresh, begun = not begun, True
        if c == "\\":
            piece, i = _escape(pattern, i, False)
            out += piece
        elif c == "[":
            piece, i = _class(pattern, i)
            out += piece
        elif c == "(" and pattern.startswith("(?", i):
            if m := re.compile(r"\(\?P?<[A-Za-z_]\w*>").match(pattern, i):
                out, i, depth, begun = out + "(", m.end(), depth + 1, False
            elif (m := re.compile(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])").match(pattern, i)) and "U" not in m[0]:
                depth, begun = depth + (m[3] == ":"), False
                on = m[1] + ("u" if "i" in m[1] else "")
                out, i = out + f"(?{on}{'-' + m[2] if m[2] else ''}{m[3]}", m.end()
            else:
                raise SelectorError(f"lookaround, atomic groups and (?U) aren't supported: {pattern!r}")
        elif c in "*+?" or (m := re.compile(r"\{\d+(?:,\d*)?\}").match(pattern, i)):
            size = 1 if c in "*+?" else m.end() - i
            if fresh:
                raise SelectorError(f"nothing to repeat: {pattern!r}")
            if was and not (c == "?" and out[-1:] != "?"):
                raise SelectorError(f"a quantifier after a quantifier: {pattern!r}")
            out, i, quantified = out + pattern[i : i + size], i + size, True
        elif c == "{":
            out, i = out + r"\{", i + 1
        elif c == "$" and not lines:
            out, i = out + r"\z", i + 1
        else:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise SelectorError(f"a group isn't open: {pattern!r}")
            begun = c not in "(|"
            out, i = out + c, i + 1
    if depth:
        raise SelectorError(f"a group isn't closed: {pattern!r}")
    return out


def grep_regex(g: Grep) -> str:
    body = to_java(g.pattern) if g.regex else "".join(map(_literal, g.pattern))
    if g.word:
        body = f"(?<![0-9A-Za-z_])(?:{body})(?![0-9A-Za-z_])"
    return f"(?diu){body}" if g.ignore_case else f"(?d){body}"


def matches(text: Column, g: Grep) -> Column:
    hit = text.rlike(grep_regex(g))
    return ~hit if g.invert else hit


def attribute(column: Column, op: str, value: str) -> Column:
    return {"=": column == value, "^=": column.startswith(value), "$=": column.endswith(value), "*=": column.contains(value)}[op] if op != "~=" else column.rlike(f"(?d){to_java(value)}")
