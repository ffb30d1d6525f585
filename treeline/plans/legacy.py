"""The older selector form, of one file's symbols: ``type[name op v]``, ``:has(...)``, ``:depth(m,n)``, space, ``>`` and commas.

It is read into the same elements as the present form and runs on the same plans.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.compiler import Compiler
from treeline.plans.selector import TAGS, Chain, Compound, Element, Pseudo, SelectorError, Test
from treeline.workspace import Workspace

_TOKEN = re.compile(r"\s*(>|,|\)|:has\(|:depth\(\s*\d+\s*(?:,\s*\d*\s*)?\)|\[\s*name\s*(?:~=|\^=|\$=|\*=|=)\s*(?:'[^']*'|\"[^\"]*\"|[^\]\s]+)\s*\]|\*|[a-z]+)")


def parse(text: str) -> list[Chain]:
    """The alternatives of a selector in the older form."""
    at = 0

    def token() -> tuple[str, bool]:
        nonlocal at
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectorError(f"expected a type, [name ...], :has or :depth at {at} in {text!r}")
        spaced = text[at : m.start(1)] != ""
        at = m.end()
        return m[1], spaced

    def more() -> bool:
        return text[at:].strip() != ""

    def chains(inner: bool) -> list[Chain]:
        out: list[Chain] = [[]]
        comb = " "
        fresh = True
        while more():
            t, spaced = token()
            if t == ")":
                if not inner:
                    raise SelectorError(f"unexpected ) in {text!r}")
                break
            if t == ",":
                if fresh:
                    raise SelectorError(f"expected a type before a comma in {text!r}")
                out.append([])
                comb, fresh = " ", True
            elif t == ">":
                comb, fresh = ">", True
            elif t == "*" or t.isalpha():
                if t != "*" and t not in TAGS:
                    raise SelectorError(f"no type {t!r}")
                out[-1].append((comb, Element(Compound(tag=None if t == "*" else t))))
                comb, fresh = " ", False
            else:
                if not out[-1] or fresh or spaced:
                    out[-1].append((comb, Element(Compound())))
                    comb, fresh = " ", False
                step, e = out[-1][-1]
                body = e.body
                if t.startswith("["):
                    m = re.fullmatch(r"\[\s*name\s*(~=|\^=|\$=|\*=|=)\s*(.*?)\s*\]", t)
                    body = replace(body, tests=[*body.tests, Test("name", m[1], m[2].strip("'\""))])
                elif t.startswith(":depth"):
                    low, _, high = re.sub(r"[^\d,]", "", t).partition(",")
                    body = replace(body, pseudos=[*body.pseudos, Pseudo("depth", (int(low), int(high) if high else None if "," in t else int(low)))])
                else:
                    body = replace(body, pseudos=[*body.pseudos, Pseudo("any", chains(True))])
                out[-1][-1] = step, replace(e, body=body)
        else:
            if inner:
                raise SelectorError(f"unclosed :has in {text!r}")
        if any(not c for c in out):
            raise SelectorError(f"expected a type in {text!r}")
        return out

    return chains(False)


def query(ws: Workspace, path: str, selector: str, limit: int = 200) -> DataFrame:
    """(node, type, path, start, end) of a file's symbols, the first ``limit`` in document order."""
    inside = Workspace(ws.nodes.where((F.col("path") == path) & (F.col("cls") != "dir")), ws.lines, ws.edges, ws.languages, ws.groups)
    tips, _ = Compiler(inside).alternatives(parse(selector))
    nodes = inside.nodes.where("cls <> 'file'").join(tips.select("id").distinct(), "id", "left_semi")
    return nodes.orderBy("ord", "id").limit(limit).select(F.col("addr").alias("node"), F.col("cls").alias("type"), "path", "start", "end")
