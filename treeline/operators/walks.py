"""Edges with their provenance: how many hops away, by which edge, how sure; and what a selector's steps cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.compiler import Compiler, cut, unfolded
from treeline.plans.selector import Compound, Edge, Element, SelectorError, parse, repaired
from treeline.workspace import Workspace


def walk(ws: Workspace, selector: str) -> DataFrame:
    """(edge, type, host, far, conf, hop, via) of a selector that ends in an edge.

    hop is the least number of crossings, within the selector's range, that
    reach the edge; via is the edge crossed before it then (the least id of
    several), null at the first hop. An unbounded range ends at the fixpoint.
    """
    compiler, parts = Compiler(ws), []
    for chain in map(unfolded, parse(selector, ws.languages)):
        last = chain[-1][1]
        if not isinstance(last.body, Edge):
            raise SelectorError("a walk ends in ::in or ::out")
        tips, kind = compiler.chain(chain[:-1] or [(" ", Element(Compound()))])
        tips = compiler.cross(tips) if kind == "edge" else tips
        parts.append(_hops(compiler, tips, last))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    names = ws.nodes.select("id", "addr")
    edges = every.join(names.toDF("host", "host_addr"), "host").join(names.toDF("far", "far_addr"), "far")
    kind = F.concat_ws(".", F.concat(F.lit("::"), F.col("dir")), F.when(F.col("kind") != "", F.col("kind")))
    edges = edges.groupBy(F.col("edge_id").alias("edge"), kind.alias("type"), F.col("host_addr").alias("host"), "conf").agg(F.min(F.struct("hop", "via")).alias("x"), F.array_sort(F.collect_set("far_addr")).alias("far"))
    return edges.select("edge", "type", "host", "far", "conf", "x.hop", "x.via")


def _hops(compiler: Compiler, tips: DataFrame, e: Element) -> DataFrame:
    """The rows of the edges crossed, each with its hop and the edge before; only edges of nodes arrived at are unfolded."""
    current = tips.select("id", F.lit(None).cast("long").alias("via")).distinct()
    out, seen, n = [], None, 0
    while e.high is None or n < e.high:
        n += 1
        rows = compiler.each(e.body, current)
        step = current.withColumnRenamed("id", "host").join(rows, "host").groupBy("edge_id", "dir", "host", "kind", "conf", "far").agg(F.min("via").alias("via")).withColumn("hop", F.lit(n))
        step = cut(step if seen is None else step.join(seen, "edge_id", "left_anti"))
        if e.high is None:
            if not step.limit(1).count():
                break
            seen = step.select("edge_id") if seen is None else seen.union(step.select("edge_id"))
        if n >= e.low:
            out.append(step)
        current = step.select(F.col("far").alias("id"), F.col("edge_id").alias("via")).distinct()
    return reduce(lambda a, b: a.unionByName(b), out) if out else step.limit(0)


def unsettled(walked: DataFrame) -> DataFrame:
    """(edges, first_hop): how many edges of a walk name several things none of which is settled, and how early the first comes."""
    return walked.where("conf = 'unsettled'").agg(F.countDistinct("edge").alias("edges"), F.min("hop").alias("first_hop"))


def notes(ws: Workspace, selector: str) -> list[str]:
    """What a result can't say for itself: relations that aren't known here, and self-calls that nothing confirms."""
    out = list(inert(selector, ws.languages))
    out += repaired(selector)[1]
    kinds, pseudos = set(), set()

    def visit(chains: list) -> None:
        for chain in chains:
            for _, e in chain:
                if isinstance(e.body, list):
                    visit([e.body])
                    continue
                kinds.update(getattr(e.body, "kinds", []))
                for p in getattr(e.body, "pseudos", []):
                    pseudos.add(p.name)
                    if isinstance(p.arg, list):
                        visit(p.arg)

    visit(parse(selector, ws.languages))
    if "implements" in kinds and not ws.edges.where("kind = 'implements'").limit(1).count():
        out.append("which types implement which isn't known here; nothing found says nothing")
    calls = ws.edges.where("dir = 'out' and kind = 'call' and conf <> 'lsp'")
    own = calls.where("host = far").select("host")
    if ws.groups is not None:  # a name's calls are met with the members that host them, not with all
        own = own.union(calls.join(ws.groups, (calls["group"] == ws.groups["group"]) & (F.col("host") == ws.groups["far"])).select("host"))
    if "recursive" in pseudos and own.limit(1).count():
        out.append("some calls may be to the caller itself, but no definition confirms it")
    return out


def inert(selector: str, languages: dict[str, str] | None = None) -> list[str]:
    """Notes on containments that no tree can have, such as a folder in a function; empty if there are none."""
    # How deep each class of node stands.
    level = {"project": 0, "dir": 1, "file": 2, "import": 4, "argument": 5, "annotation": 5, "return": 5}
    notes = []
    for chain in parse(selector, languages):
        above = None
        for comb, e in chain:
            if not isinstance(e.body, Compound):
                above = None
                continue
            tag = e.body.tag
            if above and tag and comb in (" ", ">"):
                a, b = level.get(above, 3), level.get(tag, 3)
                if b < a or a == 0 and b == 0 or a == 2 and b == 2 or a >= 4:
                    notes.append(f"no {tag} lies in {'an' if above[0] in 'aeiou' else 'a'} {above}; the selector finds nothing")
            above = tag or above
    return notes


def describe(selector: str, languages: dict[str, str] | None = None) -> list[tuple[int, str]]:
    """(depth, sentence) for each step of a selector, in the order in which it is read; what is in a condition stands deeper."""
    rows: list[tuple[int, str]] = []

    def ranged(e: Element) -> str:
        if (e.low, e.high) == (1, 1):
            return ""
        return f", {e.low} times" if e.low == e.high else f", {e.low} times or more" if e.high is None else f", {e.low} to {e.high} times"

    def tested(test) -> str:
        if hasattr(test, "parts"):
            return "(" + f" {test.op} ".join(tested(p) for p in test.parts) + ")"
        word = {"=": "is", "^=": "begins with", "$=": "ends with", "*=": "holds", "~=": "fits"}[test.op]
        return f"{test.axis} {word} {test.value!r}"

    def pseudos(body, depth: int) -> None:
        for p in getattr(body, "pseudos", []):
            if isinstance(p.arg, list):
                words = {"where": "of which something is reached by", "any": "of which something is reached by", "all": "of which everything is reached by", "empty": "of which nothing is reached by", "not": "but not", "is": "that are also", "parents": "moving up to"}
                rows.append((depth + 1, f"{words.get(p.name, p.name)}:"))
                chains(p.arg, depth + 2)
            elif p.name == "arity":
                low, high = p.arg
                rows.append((depth + 1, f"with {low}{'' if high == low else ' or more' if high is None else f' to {high}'} arguments"))
            elif p.arg is not None:
                rows.append((depth + 1, f"{p.name} a line that fits {p.arg.pattern!r}"))
            else:
                rows.append((depth + 1, {"first": "only the first of each", "last": "only the last of each", "any": "that has some", "empty": "that has none", "root": "at the root", "recursive": "that calls itself", "parents": "moving up to what holds or refers to it", "all": "all of it"}[p.name]))

    def chains(every: list, depth: int) -> None:
        for n, chain in enumerate(every):
            if n:
                rows.append((depth, "or"))
            for i, (comb, e) in enumerate(chain):
                body = e.body
                if isinstance(body, list):
                    rows.append((depth, f"a group{ranged(e)}:"))
                    chains([body], depth + 1)
                    continue
                if isinstance(body, Edge):
                    what = "references " + ("into" if body.direction == "in" else "out of") + (" it" if i else " each node") + (f" of kind {' and '.join(body.kinds)}" if body.kinds else "")
                    rows.append((depth, what + ranged(e)))
                elif isinstance(body, Compound):
                    place = "" if not i else {" ": "anywhere below, ", ">": "directly below, ", "&": "the same node, "}.get(comb, "")
                    name = "every node" if not body.tag else f"every {body.tag}"
                    parts = [f"in {x}" for x in body.langs] + [f"named {x!r}" for x in body.ids] + [f"whose {tested(t)}" for t in body.tests]
                    rows.append((depth, " ".join([place + name, *parts]).strip() + ranged(e)))
                else:
                    rows.append((depth, f"the {body.name} of it" + (f": lines that fit {body.grep.pattern!r}" if body.grep else "")))
                pseudos(body, depth)

    chains(parse(selector, languages), 0)
    return rows


GRAMMAR = """tag .lang #name [name=x] [path^=x] [name~=regex & (path*=x | name$=x)]   a node: what it is and what it is called
a b    b anywhere below a          a > b    b directly below a          a, b    either
x{2}   twice in a row              x{1,}    once or more                 (a > b){1,3}   a group, repeated
a::in  references into a           a::out.call    references out of a, by kind (call, type, import) or place (param, return, field, var)
::grep('-i -w -E -v -A2 -B1 x')    lines; ::comment ::signature ::body ::conflict ::mine ::theirs ::base    other text
:where(...) :any(...) :empty(...) :all(...) :not(...) :is(...)    conditions      :parents(...)    what holds it or refers to it
:contains('x') :annotated('x') :arity(1,2) :recursive :first :last :root"""
