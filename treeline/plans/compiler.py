"""Selectors to DataFrame plans.

The value between elements is a DataFrame (anchor, id): the tips reached from
each anchor. Containment is an equi-join on the exploded ancestor arrays of the
candidates, which are filtered first; predicates run for all tips at once and
come back as semi- and anti-joins. Only unbounded repetition and :parents loop
on the driver, over frontiers written to the shared folder.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import trigrams
from treeline.functions.patterns import attribute, matches
from treeline.operators import conflicts, intervals
from treeline.plans.closure import closure, ends
from treeline.plans.selector import Bool, Chain, Compound, Edge, Element, Generated, Grep, Pseudo, SelectorError, parse
from treeline.workspace import Workspace, edges_of, names_of, node_id, nodes_of, root, unfolded as unfolded_edges, written

CLAIMS = ("any", "empty", "all")


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read again."""
    return written(df)


def tests_column(test, id_columns: tuple[str, ...] = ("leaf", "full")) -> Column:
    """A tree of attribute tests as one boolean column over nodes."""
    if isinstance(test, Bool):
        parts = [tests_column(p) for p in test.parts]
        return reduce(lambda a, b: a & b if test.op == "and" else a | b, parts)
    columns = id_columns if test.axis == "name" else ("path",)
    return reduce(lambda a, b: a | b, [F.coalesce(attribute(F.col(c), test.op, test.value), F.lit(False)) for c in columns])


def id_column(value: str) -> Column:
    same = (F.col("leaf") == value) | (F.col("full") == value) | (F.col("addr") == value) | (F.concat(F.col("path"), F.lit("#"), F.col("leaf")) == value)
    return F.coalesce(same, F.lit(False))


class Compiler:
    def __init__(self, ws: Workspace):
        self.ws = ws
        #: The edge rows asked for, by direction and kinds, and what was unfolded on the way. A selector without edges asks for none.
        self.asked: dict[tuple, DataFrame] = {}
        self.unfolded: list[DataFrame] = []

    def rows_of(self, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The workspace's edge rows of a direction, those of all ``kinds`` if given (see ``of_kinds``)."""
        if (direction, kinds) not in self.asked:
            edges = edges_of(self.ws, direction, kinds)
            self.asked[direction, kinds] = edges if "group" in edges.columns else edges.withColumn("group", F.lit(None).cast("long"))
        return self.asked[direction, kinds]

    @property
    def links(self) -> DataFrame:
        """All edge rows that tips of this selector can be."""
        return reduce(lambda a, b: a.unionByName(b), [*self.asked.values(), *self.unfolded])

    # -- filters -------------------------------------------------------------
    def candidates(self, c: Compound, classes: set[str] | None = None, once: bool = False) -> DataFrame:
        """Nodes that pass what needs no join; ``classes``, if known, are those that it can find. once: see ``nodes_of``."""
        nodes = nodes_of(self.ws, {c.tag} if c.tag else {"project"} if any(p.name == "root" for p in c.pseudos) else classes, once)
        for lang in c.langs:
            nodes = nodes.where(F.col("lang") == lang)
        for value in c.ids:
            nodes = nodes.where(id_column(value))
        for test in c.tests:
            nodes = nodes.where(tests_column(test))
        if any(p.name == "root" for p in c.pseudos):
            nodes = nodes.where(F.col("cls") == "project")
        return nodes

    # -- chains --------------------------------------------------------------
    def alternatives(self, chains: list[Chain], start: DataFrame | None = None, relaxed: bool = False) -> tuple[DataFrame, str]:
        """(anchor, id) of all alternatives, and what the ids are: node, edge or fragment."""
        parts = [self.chain(c, start, relaxed) for c in chains]
        kinds = {k for _, k in parts}
        if len(kinds) > 1:
            raise SelectorError("alternatives must all be nodes, edges or fragments")
        return reduce(lambda a, b: a.union(b), [p.select("anchor", "id") for p, _ in parts]).distinct(), kinds.pop()

    def chain(self, steps: Chain, start: DataFrame | None = None, relaxed: bool = False) -> tuple[DataFrame, str]:
        # Without a start all tips share one anchor, so they may be taken as a set.
        tips, kind, steps, free = start, "node", unfolded(steps), start is None
        levels = getattr(self.ws, "levels", None)
        classes = {"project"} if free and levels else None
        for n, (comb, e) in enumerate(steps):
            e = single(e)
            classes = onward(levels, classes, comb, e, free and n == 0)
            if relaxed and n == len(steps) - 1:
                e = relax(e)
            if tips is None and isinstance(e.body, Compound) and (e.low, e.high) == (1, 1):
                tips = self.pseudos(self.candidates(e.body, classes).select(F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("src"), F.col("id")), e.body.pseudos, free=True)
                continue
            if tips is None:
                tips = nodes_of(self.ws, {"project"}).select(F.lit(0).cast("long").alias("anchor"), "id")
            tips, kind = self.element(tips, kind, comb, e, free, classes)
        return tips.select("anchor", "id"), kind

    def filtered(self, steps: Chain) -> DataFrame | None:
        """The nodes that a chain finds, if their own columns tell: one element of no pseudo-classes, or a depth below the project; else null."""
        steps = unfolded(steps)
        comb, e = steps[0][0], single(steps[0][1])
        if len(steps) > 1 or not isinstance(e.body, Compound) or e.body.self_ref or e.low < 1 or e.high == 0:
            return None
        classes = onward(getattr(self.ws, "levels", None), {"project"}, comb, e, True)
        if (e.low, e.high) == (1, 1):
            return None if any(p.name != "root" for p in e.body.pseudos) else self.candidates(e.body, classes)
        if not plain(e.body) or comb not in (" ", ">"):
            return None
        depth = F.size("anc") - 1
        # Nearly all nodes are the result, and are read once.
        below = self.candidates(e.body, classes, once=True).where((F.element_at("anc", 1) == root()) & (depth >= e.low))
        return below if comb == " " or e.high is None else below.where(depth <= e.high)

    def element(self, tips: DataFrame, kind: str, comb: str, e: Element, free: bool = False, classes: set[str] | None = None) -> tuple[DataFrame, str]:
        body = e.body
        if isinstance(body, Edge):
            if kind == "edge":
                tips = self.cross(tips)
            return self.hops(tips, body, e.low, e.high, free), "edge"
        if isinstance(body, Generated):
            return self.fragments(tips, body).select("anchor", "id"), "fragment"
        if kind == "fragment":
            raise SelectorError("nothing lies below a fragment")
        out, current, n = ([tips] if e.low == 0 else []), tips, 0
        if isinstance(body, Compound) and comb in (" ", ">") and plain(body) and kind == "node" and (e.low, e.high) != (1, 1) and e.high != 0:
            # Only the first of several steps may skip levels: so many levels or more.
            return self.contained(tips, self.candidates(body, classes), e.low, e.high if comb == ">" else None).select("anchor", "id").distinct(), "node"
        seen = None
        while e.high is None or n < e.high:
            n += 1
            step = comb if n == 1 else ">"
            if isinstance(body, list):
                inner = current
                k = kind
                for i, (c, x) in enumerate(body):
                    inner, k = self.element(inner, k, step if i == 0 else c, x, free)
                current, kind = inner.select("anchor", "id").distinct(), k
            else:
                current = self.compound(current, kind, step, body, free)
                kind = "node"
            if n >= e.low:
                out.append(current)
            if e.high is None and n >= e.low:
                current = current.select("anchor", "id")
                current = cut(current if seen is None else current.join(seen, ["anchor", "id"], "left_anti"))
                if not current.limit(1).count():
                    break
                out[-1] = current
                seen = current if seen is None else seen.union(current)  # each part is written already
        return reduce(lambda a, b: a.union(b), [o.select("anchor", "id") for o in out]).distinct(), kind

    def contained(self, tips: DataFrame, nodes: DataFrame, low: int, high: int | None) -> DataFrame:
        """(anchor, src, id) of nodes whose distance below a tip is low to high."""
        depth = F.size("anc") - 1
        above = nodes.select("id", depth.alias("depth"), F.posexplode("anc").alias("at", "a"))
        dist = F.col("depth") - F.col("at")
        above = above.where((dist >= low) & ((dist <= high) if high is not None else F.lit(True)))
        return tips.select("anchor", F.col("id").alias("src")).join(above.select("id", "a"), F.col("src") == F.col("a")).select("anchor", "src", "id")

    def compound(self, tips: DataFrame, kind: str, comb: str, c: Compound, free: bool = False) -> DataFrame:
        nodes = self.candidates(c)
        if kind == "edge":
            if not any(p.name in ("first", "last") for p in c.pseudos):  # only these tell one edge's ends from another's
                reach = self.contained(self.cross(tips), nodes, 0, 0 if comb == ">" else None)
                return self.pseudos(reach.select("anchor", F.lit(0).cast("long").alias("src"), "id").distinct(), c.pseudos, free=free)
            tips = self.cross(tips, keep_source=True)
            reach = self.contained(tips.select("anchor", "id"), nodes, 0, 0 if comb == ">" else None)
            reach = reach.join(tips.select("anchor", F.col("id").alias("src"), F.col("src").alias("edge")), ["anchor", "src"]).select("anchor", F.col("edge").alias("src"), "id")
        elif comb == "&" or c.self_ref and comb != ">":
            reach = tips.select("anchor", "id").join(nodes.select("id"), "id", "left_semi").select("anchor", F.col("id").alias("src"), "id")
        elif comb == ">":
            reach = tips.select("anchor", F.col("id").alias("src")).join(nodes.select("id", "parent"), F.col("src") == F.col("parent")).select("anchor", "src", "id")
        else:
            reach = self.contained(tips, nodes, 1, None)
        return self.pseudos(reach.distinct(), c.pseudos, free=free)

    # -- edges ---------------------------------------------------------------
    def edges(self, e: Edge, hosts: DataFrame | None = None, each: bool = False) -> DataFrame:
        """(edge_id, host) of an element's edges, only those of hosts (id), if given.

        A row with a group stays folded, unless ``each`` edge is asked for or its
        members are tested; rows unfolded here join ``links``.
        """
        edges, groups = self._of_kind(e, hosts), self.ws.groups
        if not (e.ids or e.tests):
            return self._unfold(edges, groups) if each and e.direction == "in" and groups is not None else edges.select("edge_id", "host").distinct()
        far = self.candidates(Compound(ids=e.ids, tests=e.tests)).select(F.col("id").alias("far"))
        out = edges.join(far, "far", "left_semi").select("edge_id", "host")
        if groups is not None:
            fit, folded = groups.join(far, "far", "left_semi"), edges.where(F.col("group").isNotNull())
            out = out.union(self._unfold(folded, fit) if e.direction == "in" else folded.join(fit.select("group").distinct(), "group", "left_semi").select("edge_id", "host"))
        return out.distinct()

    def _of_kind(self, e: Edge, hosts: DataFrame | None) -> DataFrame:
        edges = self.rows_of(e.direction, tuple(sorted(e.kinds)))
        return edges if hosts is None else edges.join(hosts.select(F.col("id").alias("host")).distinct(), "host", "left_semi")

    def each(self, e: Edge, hosts: DataFrame) -> DataFrame:
        """The rows of all of an element's edges of hosts (id), unfolded."""
        rows = unfolded_edges(self._of_kind(e, hosts), self.ws.groups)
        if not (e.ids or e.tests):
            return rows
        far = self.candidates(Compound(ids=e.ids, tests=e.tests)).select(F.col("id").alias("far"))
        return rows.join(rows.join(far, "far", "left_semi").select("edge_id").distinct(), "edge_id", "left_semi")

    def _unfold(self, edges: DataFrame, groups: DataFrame) -> DataFrame:
        rows = unfolded_edges(edges, groups)
        self.unfolded.append(rows.withColumn("group", F.lit(None).cast("long")))
        return rows.select("edge_id", "host").distinct()

    def rows(self, ids: DataFrame) -> DataFrame:
        """(edge_id, dir, host, kind, pos, conf, far) of edges (edge_id), unfolded."""
        return unfolded_edges(self.links.join(ids, "edge_id", "left_semi").distinct(), self.ws.groups).distinct()

    def count(self, tips: DataFrame, kind: str) -> DataFrame:
        """(rows): how many different tips there are; folded edges count as many as they stand for."""
        if kind != "edge" or self.ws.groups is None:
            return tips.agg(F.countDistinct("id").alias("rows"))
        sizes = self.ws.groups.groupBy("group").agg(F.countDistinct("far", "site").alias("size"))
        links = self.links.join(tips.select(F.col("id").alias("edge_id")).distinct(), "edge_id", "left_semi").distinct()
        each = links.where("dir = 'in'").join(sizes, "group").groupBy("edge_id").agg(F.sum("size").alias("n"))
        one = links.where("dir = 'out' or group is null").select("edge_id", F.lit(1).cast("long").alias("n")).distinct()
        return each.union(one).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"))

    def cross(self, tips: DataFrame, keep_source: bool = False) -> DataFrame:
        """The edges' far ends: a group is crossed once for all edges of an anchor that have it, unless their sources are kept."""
        source = ["src"] if keep_source else []
        ends = tips.select("anchor", F.col("id").alias("src")).join(self.links.select("edge_id", "far", "group"), F.col("src") == F.col("edge_id"))
        out = ends.where("far is not null").select("anchor", *source, F.col("far").alias("id"))
        if self.ws.groups is not None:
            many = ends.where(F.col("group").isNotNull()).select("anchor", *source, "group").distinct()
            out = out.union(many.join(self.ws.groups, "group").select("anchor", *source, F.col("far").alias("id")))
        return out.distinct()

    def hops(self, tips: DataFrame, e: Edge, low: int, high: int | None, free: bool = False) -> DataFrame:
        """(anchor, id) of the edges crossed low to high times: walks if bounded, a fixpoint if not."""
        if free and high is None and low <= 1 and not (e.ids or e.tests or e.pseudos):
            links = self._of_kind(e, None)
            reached = closure(tips, links, self.ws.groups).withColumnRenamed("id", "host")
            return links.join(reached, "host", "left_semi").select(F.lit(0).cast("long").alias("anchor"), F.col("edge_id").alias("id")).distinct()
        each = any(p.name in ("first", "last") for p in e.pseudos)
        bounded = (low, high) == (1, 1)
        edges = self.edges(e, tips if bounded else None, each)
        out, seen, current, n = [], None, tips.select("anchor", "id"), 0
        while high is None or n < high:
            n += 1
            if n > 1:
                current = self.cross(current)
            current = current.join(edges, F.col("id") == F.col("host")).select("anchor", F.col("id").alias("src"), F.col("edge_id").alias("id")).distinct()
            if high is None:
                current = current if seen is None else current.join(seen, ["anchor", "id"], "left_anti").select("anchor", "src", "id")
                current = cut(current)
                if not current.limit(1).count():
                    break
                seen = current.select("anchor", "id") if seen is None else seen.union(current.select("anchor", "id"))
            if n >= low:
                out.append(current)
        result = reduce(lambda a, b: a.union(b), out) if out else current.limit(0)
        return self.pseudos(result, [p for p in e.pseudos if p.name not in CLAIMS or p.arg], "edge").select("anchor", "id").distinct()

    # -- pseudo-classes ------------------------------------------------------
    def pseudos(self, reach: DataFrame, pseudos: list[Pseudo], kind: str = "node", free: bool = False) -> DataFrame:
        """reach (anchor, src, id) after the pseudo-classes in their order; :first and :last come last. free: all rows have one anchor."""
        reach = reach.withColumn("tip", F.col("id"))
        moved = False
        told_apart = any(p.name in ("first", "last") or p.name in CLAIMS and p.arg is None for p in pseudos)
        for p in pseudos:
            if p.name in ("first", "last", "root"):
                continue
            tips = reach.select(F.col("tip").alias("id")).distinct()
            if p.name == "parents" and free and not told_apart:
                none = F.lit(0).cast("long")
                reach = self.parents(tips, p.arg, ()).select(none.alias("anchor"), none.alias("src"), "id", F.col("id").alias("tip"))
            elif p.name == "parents":
                up = self.parents(tips, p.arg)
                reach = reach.join(up.withColumnRenamed("id", "up"), F.col("tip") == F.col("anchor_tip"), "left").select("anchor", "src", "id", F.col("up").alias("tip"))
                moved = True
            elif p.name in CLAIMS and p.arg is None:
                if not moved:
                    p = Pseudo(p.name, [[(">", Element(Compound()))]])
                    reach = reach.join(self.holds(tips, p), F.col("tip") == F.col("ok"), "left_semi")
                else:
                    some = reach.groupBy("anchor", "src", "id").agg(F.count("tip").alias("n"))
                    reach = some.where("n = 0" if p.name == "empty" else "n > 0" if p.name == "any" else "true").select("anchor", "src", "id", F.col("id").alias("tip"))
                    moved = False
            else:
                reach = reach.join(self.holds(tips, p), F.col("tip") == F.col("ok"), "left_semi")
        reach = reach.where("tip is not null").select("anchor", "src", F.col("tip").alias("id")).distinct()
        for p in pseudos:
            if p.name in ("first", "last"):
                order = self.ws.nodes.select("id", "ord")
                if kind == "edge":
                    ends = self.ws.nodes.select(F.col("id").alias("far"), "ord")
                    order = self.links.join(ends, "far").select("edge_id", "ord")
                    if self.ws.groups is not None:
                        least = self.ws.groups.join(ends, "far").groupBy("group").agg(F.min("ord").alias("ord"))
                        order = order.union(self.links.join(least, "group").select("edge_id", "ord"))
                    order = order.groupBy(F.col("edge_id").alias("id")).agg(F.min("ord").alias("ord"))
                by = [F.col("ord"), F.col("id")] if p.name == "first" else [F.col("ord").desc(), F.col("id").desc()]
                at = F.row_number().over(Window.partitionBy("anchor", "src").orderBy(*by))
                reach = reach.join(order, "id").withColumn("at", at).where("at = 1").select("anchor", "src", "id")
        return reach

    def holds(self, tips: DataFrame, p: Pseudo) -> DataFrame:
        """(ok): those of tips (id) for which the pseudo-class holds."""
        same = tips.select(F.col("id").alias("ok"))
        if p.name in ("contains", "annotated"):
            wanted = matches(F.col("text"), p.arg)
            hits = self.source(tips, wanted, self.lines(p.arg)) if p.name == "contains" else self.annotated(tips, wanted)
            return hits.select(F.col("host").alias("ok")).distinct()
        if p.name == "arity":
            low, high = p.arg
            args = nodes_of(self.ws, {"argument"}).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
            n = F.coalesce("n", F.lit(0))
            return same.join(args, F.col("ok") == F.col("parent"), "left").where((n >= low) & ((n <= high) if high is not None else F.lit(True))).select("ok")
        if p.name == "depth":
            low, high = p.arg
            depth = F.size("anc") - F.array_position("anc", F.col("file_id"))
            near = self.ws.nodes.where("file_id is not null").where((depth >= low) & ((depth <= high) if high is not None else F.lit(True))).select(F.col("id").alias("ok"))
            return same.join(near, "ok", "left_semi")
        if p.name == "recursive":
            own = self.rows_of("out").where("kind = 'call' and conf = 'lsp' and host = far").select(F.col("host").alias("ok"))
            return same.join(own, "ok", "left_semi")
        if p.name in ("is", "not"):
            hit = self.matching(tips, p.arg)
            return same.join(hit, F.col("ok") == F.col("hit"), "left_semi" if p.name == "is" else "left_anti")
        start = tips.select(F.col("id").alias("anchor"), "id")
        wanted = [self.reaches(tips, start, c, {"where": "any"}.get(p.name, p.name)) for c in p.arg]
        if p.name in ("empty", "all"):
            return reduce(lambda a, b: a.join(b, "ok", "left_semi"), wanted)
        return reduce(lambda a, b: a.union(b), wanted).distinct()

    def reaches(self, tips: DataFrame, start: DataFrame, chain: Chain, claim: str) -> DataFrame:
        """(ok): tips whose chain reaches something, nothing, or all that it could."""
        last = chain[-1][1]
        own = getattr(last.body, "pseudos", [])
        if own and own[-1].name in CLAIMS and own[-1].arg is None and isinstance(last.body, Edge):
            claim = own[-1].name
        same = tips.select(F.col("id").alias("ok"))
        strict, _ = self.chain(chain, start)
        if claim == "any":
            return same.join(strict.select(F.col("anchor").alias("ok")), "ok", "left_semi")
        if claim == "empty":
            return same.join(strict.select(F.col("anchor").alias("ok")), "ok", "left_anti")
        loose, _ = self.chain(chain, start, relaxed=True)
        missed = loose.join(strict, ["anchor", "id"], "left_anti").select(F.col("anchor").alias("ok"))
        return same.join(missed, "ok", "left_anti")

    def matching(self, tips: DataFrame, chains: list[Chain]) -> DataFrame:
        """(hit): those of tips that match a list themselves."""
        out = []
        for c in chains:
            if len(c) == 1 and isinstance(c[0][1].body, Compound):
                if any(p.name in ("first", "last") for p in c[0][1].body.pseudos):
                    raise SelectorError(":first and :last have no meaning for one node")
                start = tips.select(F.col("id").alias("anchor"), "id")
                out.append(self.compound(start, "node", "&", c[0][1].body).select(F.col("id").alias("hit")))
            else:
                out.append(self.chain(c)[0].select(F.col("id").alias("hit")))
        return reduce(lambda a, b: a.union(b), out).distinct()

    def parents(self, tips: DataFrame, arg: list[Chain] | None, keys: tuple[str, ...] = ("anchor_tip",)) -> DataFrame:
        """(keys, id): what contains or refers to the tips, transitively; with a list, its roots whose subject does.

        With ``anchor_tip`` as the key, for each tip, else for all of them as a
        set. A tip is among its own only if a reference leads back to it or into it.
        """
        above = self.ws.nodes.select(F.col("id").alias("child"), "anc")
        # Only sources of references in are followed round by round; containment comes from the ancestor arrays at once.
        refs = self.rows_of("in").select("host", "far", "group").distinct()
        tips = tips.select(*[F.col("id").alias(k) for k in keys], "id")

        def with_ancestors(df: DataFrame) -> DataFrame:
            return df.join(above, F.col("id") == F.col("child")).select(*keys, F.explode("anc").alias("id")).distinct()

        around = tips.join(above, F.col("id") == F.col("child")).select(*keys, F.explode(F.filter("anc", lambda a: a != F.col("child"))).alias("id"))
        first = with_ancestors(ends(tips, refs, self.ws.groups, keys)).union(around).distinct()
        if not keys:
            up = closure(first, refs, self.ws.groups, with_ancestors)
        else:
            up = frontier = cut(first)
            while True:
                new = with_ancestors(ends(frontier, refs, self.ws.groups, keys))
                frontier = cut(new.join(up, [*keys, "id"], "left_anti"))
                if not frontier.limit(1).count():
                    break
                up = up.union(frontier)
        if arg is None:
            return up
        out = []
        for c in arg:
            (comb, first), rest = c[0], c[1:]
            roots = self.pseudos(self.candidates(first.body).select(F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("src"), "id"), first.body.pseudos)
            tips_of, _ = self.chain([("&", Element(Compound())), *rest], roots.select(F.col("id").alias("anchor"), "id"))
            out.append(tips_of.select(F.col("anchor").alias("root"), F.col("id").alias("subject")).join(up, F.col("subject") == F.col("id")).select(*keys, F.col("root").alias("id")))
        return reduce(lambda a, b: a.union(b), out).distinct()

    # -- source text ---------------------------------------------------------
    def lines(self, g: Grep) -> DataFrame:
        """The lines of the files that may match a search, by the workspace's trigrams if it has any."""
        fit = None if self.ws.grams is None else trigrams.fitting(self.ws.grams, g)
        return self.ws.lines if fit is None else self.ws.lines.join(fit, "file_id", "left_semi")

    def source(self, tips: DataFrame, wanted: Column | None = None, lines: DataFrame | None = None) -> DataFrame:
        """(host, line, text): the own lines of tips (id), only those wanted; a file has all of its lines."""
        span = self.ws.nodes.join(tips, "id", "left_semi").where("file_id is not null").select(F.col("id").alias("host"), "file_id", F.col("start").alias("low"), F.col("end").alias("high")).distinct()
        lines = self.ws.lines if lines is None else lines
        lines = lines if wanted is None else lines.where(wanted)
        return intervals.within(span, lines, "file_id").select("host", "line", "text")

    def annotated(self, tips: DataFrame, wanted: Column) -> DataFrame:
        """(host): tips with a line that is wanted in the block right above them, up to a blank line, or in their first line.

        Lines between two blank ones are a block, named by the blank line before
        it. The first wanted line of a block says for every declaration below.
        """
        span = self.ws.nodes.join(tips, "id", "left_semi").where("file_id is not null and start is not null").select(F.col("id").alias("host"), "file_id", F.col("start").alias("line"))
        lines = self.ws.lines.join(span.select("file_id").distinct(), "file_id", "left_semi")
        before = Window.partitionBy("file_id").orderBy("line")
        block = F.last(F.when(F.trim("text") == "", F.col("line")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
        lines = lines.select("file_id", "line", F.coalesce(block, F.lit(0)).alias("block"), F.trim("text").alias("bare"), wanted.alias("hit"))
        first = lines.where("hit and bare <> ''").groupBy("file_id", "block").agg(F.min("line").alias("first"))
        starts = span.join(lines.select("file_id", "line", "block", "hit"), ["file_id", "line"])
        return starts.join(first, ["file_id", "block"], "left").where("hit or first < line").select("host")

    def fragments(self, tips: DataFrame, g: Generated) -> DataFrame:
        """(anchor, id, host, line, text, before, after) of the generated nodes."""
        hosts = tips.select("anchor", F.col("id").alias("host"))
        if g.name == "grep":
            pattern = matches(F.col("text"), g.grep)
            framed = g.grep.before or g.grep.after
            lines = self.source(tips.select("id").distinct(), None if framed else pattern, self.lines(g.grep))
            arrays = {"before": g.grep.before, "after": g.grep.after}
            order = Window.partitionBy("host").orderBy("line")
            none = F.expr("cast(array() as array<string>)")
            lines = lines.withColumn("before", F.collect_list("text").over(order.rowsBetween(-arrays["before"], -1)) if g.grep.before else none)
            lines = lines.withColumn("after", F.collect_list("text").over(order.rowsBetween(1, arrays["after"])) if g.grep.after else none)
            hits = lines.where(pattern) if framed else lines
        elif g.name in ("comment", "signature", "body"):
            low, high = {"comment": ("comment_start", "comment_end"), "signature": ("start", "coalesce(body_line, start)"), "body": ("body_line + 1", "end - 1")}[g.name]
            span = self.ws.nodes.join(tips.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("host"), "file_id", F.expr(low).alias("low"), F.expr(high).alias("high")).where("low > 0 and low <= high")
            text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text))
            hits = intervals.within(span, self.ws.lines, "file_id", whole=False).groupBy("host", F.col("low").alias("line")).agg(text.alias("text"))
            hits = hits.withColumns({"before": F.expr("cast(array() as array<string>)"), "after": F.expr("cast(array() as array<string>)")})
        else:
            none = F.expr("cast(array() as array<string>)")
            files = nodes_of(self.ws, {"file"}).join(tips.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("host"), "file_id")
            hits = conflicts.fragments(self.ws.lines.join(files, "file_id", "left_semi"), g.name)
            hits = files.join(hits, "file_id").select("host", "line", "text", none.alias("before"), none.alias("after"))
        out = hosts.join(hits, "host").select("anchor", node_id(g.name, F.col("host"), F.col("line")).alias("id"), "host", "line", "text", "before", "after")
        for p in g.pseudos:
            if p.name not in ("first", "last"):
                raise SelectorError(f":{p.name} doesn't apply to a fragment")
            at = F.row_number().over(Window.partitionBy("anchor", "host").orderBy(F.col("line") if p.name == "first" else F.col("line").desc(), "text"))
            out = out.withColumn("at", at).where("at = 1").drop("at")
        return out


def unfolded(steps: Chain) -> Chain:
    """A side of a ::conflict is the file's side: the region between them goes, unless it is filtered itself."""
    body = lambda i: steps[i][1].body
    inner = {i for i in range(len(steps) - 1) if isinstance(body(i), Generated) and body(i).name == "conflict" and not body(i).pseudos and isinstance(body(i + 1), Generated)}
    return [s for i, s in enumerate(steps) if i not in inner]


def single(e: Element) -> Element:
    """A repeated group of one element as that element, repeated: every step but the first goes to children in both."""
    inner = e.body[0][1] if isinstance(e.body, list) and len(e.body) == 1 else None
    whole = inner is None or not isinstance(inner.body, Compound) or (inner.low, inner.high) != (1, 1) or (e.low, e.high) == (1, 1)
    return e if whole else replace(e, body=inner.body)


def onward(levels: dict[str, tuple[str, ...]] | None, classes: set[str] | None, comb: str, e: Element, first: bool = False) -> set[str] | None:
    """The classes of node that an element can end at, from tips of ``classes``, by what may hold what; null: any. first: it is looked for anywhere."""
    body, once = e.body, (e.low, e.high) == (1, 1)
    if isinstance(body, list) and once:
        for i, (c, x) in enumerate(body):
            classes = onward(levels, classes, comb if i == 0 else c, single(x))
        return classes
    if not isinstance(body, Compound) or any(p.name == "parents" for p in body.pseudos):
        return None
    if body.tag and e.low > 0:
        return {body.tag}
    if levels is None:
        return None
    if first and once:
        return set(levels)
    if classes is None or body.tag or body.self_ref or comb not in (" ", ">"):
        return None
    below = lambda of: {c for c, above in levels.items() if of & set(above)}
    found, near = set(classes) if e.low == 0 else set(), classes
    for n in range(1, (e.low + len(levels) if e.high is None else e.high) + 1):
        near = below(near)
        if n == 1 and comb == " ":
            while not below(near) <= near:
                near = near | below(near)
        found |= near if n >= e.low else set()
        if not near:
            break
    return found


def one_edge(steps: Chain) -> bool:
    """Whether a chain ends by crossing, once, from nodes or edges to any edge of a kind."""
    e = steps[-1][1]
    return len(steps) > 1 and isinstance(e.body, Edge) and (e.low, e.high) == (1, 1) and not (e.body.ids or e.body.tests or e.body.pseudos) and not any(isinstance(x.body, Generated) for _, x in steps)


def plain(c: Compound) -> bool:
    return not (c.tag or c.langs or c.ids or c.tests or c.pseudos or c.self_ref)


def relax(e: Element) -> Element:
    """The element without the constraints of its own; structure and direction stay."""
    if isinstance(e.body, Compound):
        return replace(e, body=Compound(self_ref=e.body.self_ref))
    if isinstance(e.body, Edge):
        return replace(e, body=Edge(e.body.direction))
    return e


def named(ws: Workspace, chains: list[Chain]) -> DataFrame:
    """The nodes that a selector can end at: only those of the classes that its last elements name or can lead to, if that is known."""
    levels, found = getattr(ws, "levels", None), set()
    for c in chains:
        classes = {"project"} if levels else None
        for n, (comb, e) in enumerate(c):
            classes = onward(levels, classes, comb, single(e), n == 0)
        if classes is None:
            return ws.nodes
        found |= classes
    return nodes_of(ws, found)


def query(ws: Workspace, selector: str) -> DataFrame:
    """The selector's result.

    Nodes: (node, type, path, start, end). Edges: (edge, type, host, far, conf)
    with far sorted. Fragments: (node, line, text, before, after).
    """
    chains = parse(selector, ws.languages)
    compiler = Compiler(ws)
    last = chains[0][-1][1].body
    if isinstance(last, Generated):
        parts, heads = [], []
        for c in map(unfolded, chains):
            head = c[:-1] or [(" ", Element(Compound()))]
            heads.append(head)
            tips, kind = compiler.chain(head)
            parts.append(compiler.fragments(compiler.cross(tips) if kind == "edge" else tips, c[-1][1].body))
        hits = reduce(lambda a, b: a.union(b), parts)
        if len(parts) > 1 or last.name != "grep":  # one grep finds a line once; rows that repeat a file's id have lines of their own
            hits = hits.dropDuplicates(["id"])
        hosts = named(ws, heads).select(F.col("id").alias("host"), F.col("addr").alias("node"))
        return hits.join(hosts.distinct(), "host").select("node", "line", "text", "before", "after")
    if len(chains) == 1 and (nodes := compiler.filtered(chains[0])) is not None:
        return nodes.select(F.col("addr").alias("node"), F.col("cls").alias("type"), "path", "start", "end")
    if all(map(one_edge, chains)):
        # What the tips' edges are is told by their hosts: no ids of edges are gathered and looked up again.
        heads, parts = [unfolded(c)[:-1] for c in chains], []
        for head, c in zip(heads, chains, strict=True):
            tips, kind = compiler.chain(head)
            parts.append(compiler.each(c[-1][1].body, compiler.cross(tips) if kind == "edge" else tips))
        return with_names(reduce(lambda a, b: a.unionByName(b), parts), named(ws, heads), names_of(ws))
    tips, kind = compiler.alternatives(chains)
    ids = tips.select("id").distinct()
    if kind == "node":
        return named(ws, chains).join(ids, "id", "left_semi").select(F.col("addr").alias("node"), F.col("cls").alias("type"), "path", "start", "end")
    return with_names(compiler.rows(ids.withColumnRenamed("id", "edge_id")), names_of(ws), names_of(ws))


def tally(ws: Workspace, selector: str) -> DataFrame:
    """(host, n): how many edges a selector that ends by crossing once finds at each node.

    The edges' far ends aren't looked up, and groups count as many as they have
    members without being unfolded.
    """
    chains = parse(selector, ws.languages)
    if not all(map(one_edge, chains)):
        raise SelectorError("only edges that are crossed once, and to anything, are tallied")
    compiler, heads, parts = Compiler(ws), [unfolded(c)[:-1] for c in chains], []
    for head, c in zip(heads, chains, strict=True):
        tips, kind = compiler.chain(head)
        parts.append(compiler._of_kind(c[-1][1].body, compiler.cross(tips) if kind == "edge" else tips).select("dir", "edge_id", "host", "group"))
    rows, groups = reduce(lambda a, b: a.unionByName(b), parts), ws.groups
    folded = (F.col("dir") == "in") & F.col("group").isNotNull()
    found = (rows if groups is None else rows.where(~folded)).select("host", "edge_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    if groups is not None:
        sizes = groups.groupBy("group").agg(F.countDistinct("far", "site").alias("size"))
        found = found.union(rows.where(folded).select("host", "edge_id", "group").distinct().join(sizes, "group").groupBy("host").agg(F.sum("size").alias("n")))
    hosts = named(ws, heads).select(F.col("id").alias("host"), "addr")
    return found.join(hosts.distinct(), "host").groupBy(F.col("addr").alias("host")).agg(F.sum("n").alias("n"))


def with_names(edges: DataFrame, hosts: DataFrame, fars: DataFrame) -> DataFrame:
    """(edge, type, host, far, conf) of edge rows, unfolded, whose ends are nodes of ``hosts`` and ``fars``; repeated rows are one."""
    names, hosts = fars.select("id", "addr"), hosts.select("id", "addr")
    edges = edges.join(hosts.toDF("host", "host_addr"), "host").join(names.toDF("far", "far_addr"), "far")
    kind_name = F.concat_ws(".", F.concat(F.lit("::"), F.col("dir")), F.when(F.col("kind") != "", F.col("kind")))
    return edges.groupBy(F.col("edge_id").alias("edge"), kind_name.alias("type"), F.col("host_addr").alias("host"), "conf").agg(F.array_sort(F.collect_set("far_addr")).alias("far")).select("edge", "type", "host", "far", "conf")
