"""Pages of results in document order, and their forms: JSON rows, files with their rows, indented text."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import read, walks
from treeline.plans.compiler import Compiler, query
from treeline.plans.selector import Compound, SelectorError, parse
from treeline.workspace import Workspace

DEFAULT_ROWS = 20


@dataclass
class Page:
    rows: DataFrame
    every: DataFrame
    selector: str = ""
    ws: Workspace | None = None

    def total(self) -> int:
        """All rows, not only the page's."""
        return self.every.count()

    def json(self) -> DataFrame:
        return to_json(self.rows)

    def document(self) -> dict:
        """The page with what is to be known about it: how the selector was read, the total, whether rows are left out, notes, a hint for nothing found."""
        rows, total = [r.asDict() for r in self.rows.collect()], self.total()  # a page's rows are bounded by its limit
        told = walks.describe(self.selector, self.ws.languages)
        return {"read": ["  " * depth + line for depth, line in told], "subject": told[0][1], "rows": rows, "total": total, "truncated": len(rows) < total, "notes": walks.notes(self.ws, self.selector), "hint": None if total else hint(self.ws, self.selector)}


def page(ws: Workspace, selector: str, limit: int = DEFAULT_ROWS, offset: int = 0) -> Page:
    """A node selector's rows from ``offset`` in document order, at most ``limit``; 0 for all."""
    if limit < 0 or offset < 0:
        raise SelectorError("limit and offset are 0 or more")
    every = query(ws, selector)
    if "node" not in every.columns or "text" in every.columns:
        raise SelectorError("pages are of nodes; edges and fragments have no place of their own")
    order = ws.nodes.select(F.col("addr").alias("node"), F.col("cls").alias("type"), "ord")
    rows = every.join(order, ["node", "type"]).orderBy("ord", "node")
    rows = rows.offset(offset) if offset else rows
    return Page((rows.limit(limit) if limit else rows).drop("ord"), every, selector, ws)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def by_file(rows: DataFrame) -> DataFrame:
    """(path, rows): each file's rows as an array; for a page, whose size is bounded. With an ``ord``, files come in the order of their first rows."""
    if "ord" in rows.columns:
        rest = [c for c in rows.columns if c not in ("path", "ord")]
        grouped = rows.groupBy("path").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("rows"))
        return grouped.orderBy("first").select("path", F.transform("rows", lambda r: r.dropFields("ord")).alias("rows"))
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in rest if c != "start"]))).alias("rows"))


def as_text(rows: DataFrame) -> DataFrame:
    """(path, text): a file's name and its rows below it, drawn as a tree."""
    grouped = by_file(rows)
    last = F.size("rows") - 1
    line = F.transform("rows", lambda r, i: F.concat(F.when(i == last, "└─ ").otherwise("├─ "), r.type, F.lit(" "), F.element_at(F.split(r.node, "#"), -1), F.when(r.start.isNotNull(), F.concat(F.lit(" @"), r.start.cast("string"), F.when(r.end > r.start, F.concat(F.lit("-"), r.end.cast("string"))).otherwise(""))).otherwise("")))
    return grouped.select("path", F.concat_ws("\n", F.coalesce("path", F.lit("")), F.concat_ws("\n", line)).alias("text"))


def explain(ws: Workspace, selector: str) -> DataFrame:
    """(alternative, step, element, rows): what each element of the selector leaves, measured; a plain count for each prefix."""
    out = None
    for n, chain in enumerate(parse(selector, ws.languages), 1):
        for i in range(1, len(chain) + 1):
            compiler = Compiler(ws)
            tips, kind = compiler.chain(chain[:i])
            one = compiler.count(tips, kind).select(F.lit(n).alias("alternative"), F.lit(i).alias("step"), F.lit(kind).alias("element"), "rows")
            out = one if out is None else out.unionByName(one)
    return out


def cost(ws: Workspace, selector: str) -> list[dict]:
    """For each element of the selector: what the optimiser expects to read (bytes), the rows that come out, and the time taken."""
    out = []
    for n, chain in enumerate(parse(selector, ws.languages), 1):
        for i in range(1, len(chain) + 1):
            compiler = Compiler(ws)
            tips, kind = compiler.chain(chain[:i])
            ids = compiler.count(tips, kind)
            expected = int(str(ids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            start = time.perf_counter()
            rows = ids.first()[0]
            out.append({"alternative": n, "step": i, "element": kind, "expected_bytes": expected, "rows": rows, "seconds": round(time.perf_counter() - start, 3)})
            if not rows:
                break  # what follows isn't reached
    return out


def hint(ws: Workspace, selector: str) -> str | None:
    """Why a selector finds nothing: the first prefix without a result, and the tag or tests that end it; null if it finds something."""
    for chain in parse(selector, ws.languages):
        for i in range(1, len(chain) + 1):
            tips, _ = Compiler(ws).chain(chain[:i])
            if tips.limit(1).count():
                if i == len(chain):
                    return None
                continue
            body = chain[i - 1][1].body
            if isinstance(body, Compound) and body.ids and not Compiler(ws).candidates(Compound(ids=body.ids)).limit(1).count():
                near = [r["leaf"] for r in read.near_names(ws, body.ids[0].split("#")[-1]).collect()]
                return f"step {i}: nothing is named {body.ids[0]!r}" + (f"; near it are {', '.join(near)}" if near else "")
            if isinstance(body, Compound) and body.tag and (body.ids or body.tests):
                bare = Compiler(ws).candidates(Compound(ids=body.ids, tests=body.tests))
                if found := bare.select("cls").limit(1).collect():
                    return f"step {i}: no {body.tag}, but a {found[0]['cls']} of that name; drop the tag"
            return f"step {i} finds nothing{'; the steps before it do' if i > 1 else ''}"
    return None
