"""The tables a selector runs on.

nodes (id, cls, leaf, full, addr, path, lang, parent, anc, file_id, ord, start, end)
    anc: ids from the root down to the node itself; ord: document order.
    Optional: comment_start, comment_end, body_line.
lines (file_id, line, text)
edges (edge_id, dir, host, kind, pos, conf, far[, group]), a row for each far end,
    or one row whose far ends are all members of a group; far is null then.
groups (group, far, site): the members. A name's sites and its declarations are
    kept once, as members, so edges grow with the sites and the declarations and
    not with their product. A row of direction in that has a group stands for an
    edge to each member, which ``unfolded`` makes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.plans.selector import LANGUAGES

NODE_COLUMNS = ("id", "cls", "leaf", "full", "addr", "path", "lang", "parent", "anc", "file_id", "ord", "start", "end")
EDGE_SCHEMA = "edge_id long, dir string, host long, kind string, pos string, conf string, far long"


def node_id(*key: Column | str) -> Column:
    """An id that depends on the key only, so that it is the same in every run."""
    return F.xxhash64(*[F.lit(k) if isinstance(k, str) else k for k in key])


def root() -> Column:
    """The project's id; made on use, as columns need a running session."""
    return node_id("project")


def node_rows(df: DataFrame, cls: str, key: list[Column], leaf: Column, addr: Column, path: Column, parent_anc: list[Column], ord_: Column, lang: Column | None = None, full: Column | None = None, file_id: Column | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Node rows of one class; ``parent_anc`` are the ids above, root first."""
    own = node_id(cls, *key)
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    number = lambda c: F.lit(None).cast("int") if c is None else c.cast("int")
    parent = parent_anc[-1] if parent_anc else F.lit(None).cast("long")
    file = own if cls == "file" else F.lit(None).cast("long") if file_id is None else file_id
    return df.select(own.alias("id"), F.lit(cls).alias("cls"), leaf.cast("string").alias("leaf"), (leaf if full is None else full).cast("string").alias("full"), addr.cast("string").alias("addr"), path.cast("string").alias("path"), text(lang).alias("lang"), parent.alias("parent"), F.array(*parent_anc, own).alias("anc"), file.alias("file_id"), ord_.cast("string").alias("ord"), number(start).alias("start"), number(end).alias("end"))


def project(spark, name: str) -> DataFrame:
    return spark.range(1).select(root().alias("id"), F.lit("project").alias("cls"), F.lit(name).alias("leaf"), F.lit(name).alias("full"), F.lit(name).alias("addr"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("parent"), F.array(root()).alias("anc"), F.lit(None).cast("long").alias("file_id"), F.lit("").alias("ord"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def by_class(nodes: DataFrame, classes: Iterable[str]) -> dict[str, DataFrame]:
    """``Workspace.parts`` of a union of tables each of one class: the filters leave out the other classes' tables."""
    return {c: nodes.where(F.col("cls") == c) for c in classes}


def both_directions(out_edges: DataFrame) -> DataFrame:
    """Edge rows under the source and, mirrored, under the target; out_edges has (src, dst, kind, pos, conf, site)."""
    out = out_edges.select(node_id("out", F.col("src"), F.col("site")).alias("edge_id"), F.lit("out").alias("dir"), F.col("src").alias("host"), "kind", "pos", "conf", F.col("dst").alias("far"))
    into = out_edges.select(node_id("in", F.col("dst"), F.col("src"), F.col("site")).alias("edge_id"), F.lit("in").alias("dir"), F.col("dst").alias("host"), "kind", "pos", "conf", F.col("src").alias("far"))
    return out.unionByName(into)


@dataclass
class Workspace:
    nodes: DataFrame
    lines: DataFrame
    edges: DataFrame
    languages: dict[str, str] = field(default_factory=lambda: dict(LANGUAGES))
    groups: DataFrame | None = None
    #: (file_id, text) of whole files, for an index of their trigrams.
    texts: DataFrame | None = None
    grams: DataFrame | None = None
    #: If known, the nodes by class, so that a class can be made without the others; those of classes not named here are under "".
    parts: dict[str, DataFrame] | None = None
    #: If known, the classes that may hold each class directly.
    levels: dict[str, tuple[str, ...]] | None = None


class Narrowed:
    """A workspace with lines of its own, and no index of them; all else, such as edges, is the other's, made when asked for."""

    grams = None

    def __init__(self, ws, lines: DataFrame):
        self._ws, self.lines = ws, lines

    def __getattr__(self, name: str):
        return getattr(self._ws, name)


class LinkedWorkspace:
    """A workspace whose edges are only looked for when asked for, and then written: ``link`` gives (edges, groups, further nodes or null)."""

    def __init__(self, nodes: DataFrame, lines: DataFrame, link: Callable[[], tuple[DataFrame, DataFrame, DataFrame | None]], linked_nodes: bool, parts: dict[str, DataFrame]):
        self.parts = None if linked_nodes else parts
        self._nodes, self.lines, self._link, self._linked_nodes = nodes, lines, link, linked_nodes
        self.languages = dict(LANGUAGES)
        self.texts = self.grams = self.levels = None

    @cached_property
    def _linked(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        edges, groups, nodes = self._link()
        return written(edges, "dir"), written(groups), None if nodes is None else written(nodes)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes.unionByName(self._linked[2]) if self._linked_nodes else self._nodes

    @cached_property
    def edges(self) -> DataFrame:
        return self._linked[0]

    @cached_property
    def groups(self) -> DataFrame | None:
        return self._linked[1]


def unfolded(edges: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(edge_id, dir, host, kind, pos, conf, far): edges with their groups' members in their rows' place; cut edges down first."""
    columns = ["edge_id", "dir", "host", "kind", "pos", "conf", "far"]
    if groups is None or "group" not in edges.columns:
        return edges.select(columns)
    many = edges.where(F.col("group").isNotNull()).drop("far").join(groups, "group")
    own = F.when(F.col("dir") == "in", node_id("in", F.col("host"), F.col("far"), F.col("site"))).otherwise(F.col("edge_id"))
    return edges.where(F.col("group").isNull()).select(columns).unionByName(many.withColumn("edge_id", own).select(columns))


def of_kinds(edges: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """Edge rows of a direction whose kind or position is each of ``kinds``; null: of any kind, else ``implements`` must be named."""
    edges = edges.where(F.col("dir") == direction)
    if kinds is not None and "implements" not in kinds:  # a relation of its own, crossed only by name
        edges = edges.where("kind <> 'implements'")
    for kind in kinds or ():
        edges = edges.where((F.col("kind") == kind) | (F.col("pos") == kind))
    return edges


def nodes_of(ws, classes: set[str] | None, once: bool = False) -> DataFrame:
    """A workspace's nodes of some classes, or all if null; one that stores them makes no others. once: they are read a single time, so storing them doesn't pay."""
    own = getattr(ws, "nodes_of", None)
    if own and classes is not None:
        return own(classes, once)
    return ws.nodes if classes is None else ws.nodes.where(F.col("cls").isin(sorted(classes)))


def names_of(ws) -> DataFrame:
    """(id, addr) of a workspace's nodes."""
    own = getattr(ws, "names", None)
    return ws.nodes.select("id", "addr") if own is None else own


def edges_of(ws, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``of_kinds`` of a workspace's edges; one that stores them makes no others."""
    own = getattr(ws, "edges_of", None)
    return own(direction, kinds) if own else of_kinds(ws.edges, direction, kinds)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is set, a local one in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/treeline-scratch"


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{scratch_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


class StoredWorkspace:
    """A workspace whose nodes and edges are built once, on first use, and written to the shared folder.

    Nodes are built by class, and edges by direction and kinds: what no selector
    has asked for yet isn't made. Selectors then read only the classes that they
    name, instead of building every table's tree again for each of their steps.
    Lines stay views. With ``trigrams``, an index of the files' trigrams is written, too, and searches
    read only the files that it leaves.
    """

    def __init__(self, made: Callable[[], Workspace], trigrams: Callable[[DataFrame], DataFrame] | None = None):
        self._made, self._trigrams = made, trigrams
        self._classes: dict[str, DataFrame] = {}
        self._asked: dict[tuple, DataFrame] = {}

    @cached_property
    def _plain(self) -> Workspace:
        return self._made()

    @cached_property
    def nodes(self) -> DataFrame:
        parts = self._plain.parts
        return written(self._plain.nodes, "cls") if parts is None else union([self._class(c) for c in parts])

    @property
    def levels(self) -> dict[str, tuple[str, ...]] | None:
        return self._plain.levels

    def _class(self, cls: str) -> DataFrame:
        """The rows of a class or, for "", of all that have no part of their own."""
        if cls not in self._classes:
            rows = self._plain.parts[cls]
            # The class stands in the plan, so that a filter on it leaves the other classes' files closed.
            self._classes[cls] = written(rows.drop("cls")).withColumn("cls", F.lit(cls)).select(rows.columns) if cls else written(rows, "cls")
        return self._classes[cls]

    def nodes_of(self, classes: set[str], once: bool = False) -> DataFrame:
        parts = self._plain.parts
        if parts is None:
            return self.nodes.where(F.col("cls").isin(sorted(classes)))
        others = sorted(classes - set(parts))
        frames = [parts[c] if once and c not in self._classes else self._class(c) for c in sorted(classes & set(parts) - {""})]
        if others and ("" in parts or not frames):
            frames.append(self._class("" if "" in parts else min(parts)).where(F.col("cls").isin(others)))
        return union(frames)

    @property
    def names(self) -> DataFrame:
        """(id, addr) of all nodes: classes that aren't stored yet are read from their tables, as two columns don't pay for writing them."""
        parts = self._plain.parts
        if parts is None:
            return self.nodes.select("id", "addr")
        return union([(self._class(c) if c in self._classes or not c else rows).select("id", "addr") for c, rows in parts.items()])

    @cached_property
    def edges(self) -> DataFrame:
        return self._plain.edges if isinstance(self._plain, LinkedWorkspace) else written(self._plain.edges, "dir")

    def edges_of(self, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
        if isinstance(self._plain, LinkedWorkspace) or "edges" in self.__dict__:
            return of_kinds(self.edges, direction, kinds)
        if (direction, kinds) not in self._asked:
            self._asked[direction, kinds] = written(of_kinds(self._plain.edges, direction, kinds))
        return self._asked[direction, kinds]

    @cached_property
    def groups(self) -> DataFrame | None:
        return self._plain.groups

    @cached_property
    def grams(self) -> DataFrame | None:
        return None if self._trigrams is None or self._plain.texts is None else written(self._trigrams(self._plain.texts))

    @property
    def lines(self) -> DataFrame:
        return self._plain.lines

    @property
    def languages(self) -> dict[str, str]:
        return self._plain.languages
