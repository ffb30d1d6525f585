"""Sets derived by hand from a small stock keeper in three languages."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.operators import intervals, results, walks
from treeline.plans import closure
from treeline.plans.compiler import query, tally
from treeline.sources import code, details
from treeline.workspace import StoredWorkspace, Workspace, both_directions

# Calls: open -> load, check; load -> parse; check -> parse (a diamond); ping <-> pong (a cycle);
# walk -> walk (a loop of one); nobody calls open, walk apart from itself, or orphan.
STORE = """package stock

import "fmt"

// Shelf holds crates.
type Shelf struct {
	Name  string `json:"name" db:"shelf_name"`
	crate Crate
}

type Crate interface{ Weigh() int }

func open(path string) (Shelf, error) {
	check(path)
	return load(path)
}

func load(path string) (Shelf, error) { return parse(path) }

func check(path string) { parse(path) } // looks only

func parse(text string) (Shelf, error) { return Shelf{}, nil }

func ping(n int) { pong(n) }

func pong(n int) { ping(n - 1) }

func walk(depth int, shelf Shelf) { walk(depth-1, shelf) }

func orphan() {}

var (
	first = parse
	limit = 3
)
"""
TOOLS = """import os

LIMIT: Count = 4


# Finds a crate.
@cached(size=3)
def find(name, *rest) -> Crate:
    \"\"\"parse is only spoken of here\"\"\"
    return lookup(name)


def lookup(name):
    return os.environ[name]


class Desk:
    owner = None

    def __init__(self, owner):
        self.owner = owner

    def find(self, name):
        return lookup(name)
"""
PANEL = """package ui;

/** A panel. */
@Deprecated
public class Panel {
  private Shelf shelf;
  public Panel(Shelf shelf) { this.shelf = shelf; }
  void show(int a) { show(a, 0); }
  Crate show(int a, int b) { return null; }
}
"""
FILES = [("stock/store.go", STORE), ("tools/find.py", TOOLS), ("ui/Panel.java", PANEL), ("notes.txt", "plain\n"), ("tools/broken.py", "def ("), ("tools/deep.py", "x = " + "(" * 3000 + ")" * 3000), ("tools/none.py", None)]


@pytest.fixture(scope="module")
def ws(spark):
    w = code.workspace(spark.createDataFrame(FILES, "path string, content string"))
    w.nodes, w.edges, w.lines = w.nodes.cache(), w.edges.cache(), w.lines.cache()
    return w


def nodes(ws, selector):
    return {r["node"].split("#")[-1] for r in query(ws, selector).collect()}


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("#'stock/store.go#open' > argument", {"open.path"}),
        ("#'stock/store.go#open'::out.call > *", {"check", "load"}),
        ("#'stock/store.go#parse'::in.call > *", {"load", "check"}),
        ("#'stock/store.go#parse'::in.call{1,} > *", {"load", "check", "open"}),
        ("#'stock/store.go#parse'::in.call{2,2} > *", {"open"}),
        ("#'stock/store.go#ping'::in.call{1,} > *", {"ping", "pong"}),
        ("#'stock/store.go#walk'::out.call > *", {"walk"}),
        ("#'stock/store.go#first'::out > *", {"parse"}),
        ("func.go:where(::in:empty)", {"open", "orphan"}),
        ("func.go:where(::out.call:empty)", {"parse", "orphan"}),
        ("#'stock/store.go#parse':parents(func)", {"load", "check", "open"}),
        ("#'stock/store.go#parse':parents(dir)", {"stock"}),
        ("#'tools/find.py#lookup'::in.call > *", {"find", "Desk.find"}),
        ("*:parents:empty", {"workspace"}),
        ("func.py", {"find", "lookup"}),
        ("file > func:first", {"open", "find"}),
        ("(dir file){1} > class", {"Desk", "Panel"}),
        ("func:arity(2)", {"walk", "find"}),
        ("method:arity(1)", {"Panel.show[1]", "Desk.find"}),
        ("method:arity(2)", {"Panel.show[2]"}),
        ("method#'Panel.show[2]' > argument", {"Panel.show[2].a", "Panel.show[2].b"}),
        ("struct > field", {"Shelf.Name", "Shelf.crate"}),
        ("annotation", {"Shelf.Name.json", "Shelf.Name.db", "find.cached", "Panel.Deprecated"}),
        ("func.go > return#Shelf", {"open.Shelf", "load.Shelf", "parse.Shelf"}),
        ("return#Crate", {"find.Crate", "Panel.show[2].Crate"}),
        ("const, var", {"first", "limit", "LIMIT"}),
        ("file#store.go > *{0}", {"stock/store.go"}),
        ("func.go:contains('parse(')", {"load", "check", "parse"}),
        ("func.go:not(#open, #load)", {"check", "parse", "ping", "pong", "walk", "orphan"}),
        ("func:annotated('cached')", {"find"}),
        ("struct#Shelf::in.return > func", {"open", "load", "parse"}),
        ("struct#Shelf::in.param > *", {"walk", "Panel.Panel"}),
        ("struct#Shelf::in.field > *", {"Panel.shelf"}),
        ("interface#Crate::in.field > *", {"Shelf.crate"}),
        ("file#broken.py > *, file#deep.py > func", set()),
    ],
)
def test_node_sets(ws, selector, want):
    assert nodes(ws, selector) == want


@pytest.mark.parametrize(("selector", "n"), [("#'stock/store.go#parse'::in", 3), ("#'stock/store.go#parse'::in.call", 2), ("#'tools/find.py#lookup'::in", 2)])
def test_edge_counts(ws, selector, n):
    assert query(ws, selector).count() == n


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("struct#Shelf::comment", {"// Shelf holds crates."}),
        ("func#check::comment", {"func check(path string) { parse(path) } // looks only"}),
        ("func#find::comment", {"# Finds a crate."}),
        ("class#Panel::comment", {"/** A panel. */"}),
        ("func#open::signature", {"func open(path string) (Shelf, error) {"}),
        ("func#open::body", {"\tcheck(path)\n\treturn load(path)"}),
    ],
)
def test_generated_text(ws, selector, want):
    assert {r["text"] for r in query(ws, selector).collect()} == want


def test_contains_sets(ws):
    assert {"open", "tools/find.py"} <= nodes(ws, ":root > *{2,3}") and "stock/store.go" not in nodes(ws, ":root > *{1}")
    assert {"stock/store.go", "open"} <= nodes(ws, "#'stock/store.go' > *{0,1}")
    assert "stock/store.go" not in nodes(ws, "file#store.go *")
    every = nodes(ws, "func:where(::in.call:all)")
    assert "load" in every and "parse" not in every


def test_ids_are_one_to_one(ws):
    symbols = ws.nodes.where("cls not in ('project', 'dir', 'file')")
    assert symbols.count() == symbols.select("id").distinct().count()
    assert symbols.join(ws.nodes.selectExpr("id as parent"), "parent", "left_anti").count() == 0


def test_files_with_faults(spark):
    rows = [*FILES, ("a.xml", "<a><b></a>"), ("b.go", "func f() {"), ("c.md", "((")]
    got = {r["path"]: r["clean"] for r in code.clean_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert {p for p, clean in got.items() if not clean} >= {"tools/broken.py", "a.xml", "b.go"}
    assert got["stock/store.go"] and got["c.md"] and got["tools/find.py"] and "notes.txt" not in got


def test_sites_of_other_languages():
    assert {s[0] for s in code.sites_of('<r><string name="hi">words here</string><V id="@+id/box"/></r>', "xml")} == {"r", "string", "hi", "V", "box"}
    assert {s[0] for s in code.sites_of("const q = gql`query Q { user(id: $x) { name } }`;", "typescript")} == {"q", "gql", "Q", "user", "id", "name"}
    assert "map" in {s[0] for s in code.sites_of("y = map(f, new)", "python")}
    assert {s[0] for s in code.sites_of("SELECT a FROM t -- b", "sql")} == {"a", "t"}


def test_nested_duplicates_keep_their_children():
    decls = [("f", "func", "f", 1, 3, 1, 6, 1), ("f.a", "argument", "a", 1, 1, 1, 8, 0), ("f", "func", "f", 4, 6, 4, 6, 4), ("f.a", "argument", "a", 4, 4, 4, 8, 0)]
    assert [n for n, _ in details.nested(decls)] == ["f[1]", "f[1].a", "f[2]", "f[2].a"]


def test_external_and_collisions(spark, ws):
    paths = ["/go/pkg/mod/example.org/x/y@v1.2/a.go", "/w/node_modules/@s/p/i.js", "/w/node_modules/q/i.js", "/lib/site-packages/num/a.py", "/usr/src/fmt/print.go", "/home/x.go"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(code.external(F.col("p"))).collect()]
    assert got == ["example.org/x/y", "@s/p", "q", "num", "fmt", None]
    assert tuple(code.collisions(ws).first()) == (3, 76)


IGNORE = ["*.log", "!keep.log", "/out", "tmp/", "doc/**/x.md", "# note", "", "a?c.[ch]"]


def test_ignored_paths(spark):
    want = {"a.log": True, "d/b.log": True, "d/keep.log": False, "out/x.go": True, "d/out/x.go": False, "tmp/a": True, "d/tmp/a": True, "tmp": False, "doc/x.md": True, "doc/p/q/x.md": True, "abc.c": True, "abbc.c": False}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["x"] for r in rows.withColumn("x", code.ignored(F.col("path"), IGNORE)).collect()} == want


def test_definitions_settle_ambiguous_edges(spark):
    files = [("a.go", "package a\nfunc Run() {}\n"), ("b.go", "package b\nfunc Run() {}\n"), ("c.go", "package c\nfunc Go1() { Run() }\n")]
    frame = spark.createDataFrame(files, "path string, content string")
    assert {r["conf"] for r in query(code.workspace(frame), "#Go1::out.call").collect()} == {"unsettled"}
    defs = spark.createDataFrame([("c.go", 2, 14, "b.go", 2)], "path string, line int, col int, def_path string, def_line int")
    (edge,) = query(code.workspace(frame, definitions=defs), "#Go1::out.call").collect()
    assert edge["conf"] == "lsp" and edge["far"] == ["b.go#Run"]


def test_scan_reads_text_files_only(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "bin.py").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules" / "b.py").write_text("y = 1\n")
    (tmp_path / "pkg" / "build").write_text("a file, no folder\n")
    assert sorted(r["path"] for r in code.scan(spark, str(tmp_path)).collect()) == ["pkg/a.py", "pkg/build"]
    assert [r["path"] for r in code.scan(spark, str(tmp_path), ignore=["*.py"]).collect()] == ["pkg/build"]


def hot_files(n):
    """n files that each declare and call a method of the same name."""
    return [(f"f{i}.java", f"package p;\nclass Box{i} {{\n  void go(int a) {{ go(a); other{i}(a); }}\n}}\n") for i in range(n)]


def test_edges_grow_with_sites_and_declarations_not_their_product(spark):
    rows = {}
    for n in (10, 40):
        w = code.workspace(spark.createDataFrame(hot_files(n), "path string, content string"))
        rows[n] = w.edges.count() + w.groups.count()
    assert rows[40] < 4.5 * rows[10]
    assert query(w, "method#go::in.call > method").count() == 40
    assert query(w, "#'f3.java#Box3.go'::in.call").count() == 40  # each of the name's sites is an edge of its own
    assert {len(r["far"]) for r in query(w, "#'f3.java#Box3.go'::out.call#go").collect()} == {40}
    assert query(w, "#'f3.java#Box3.go'::in.call#'f7.java#Box7.go'").count() == 1
    assert [r["far"] for r in query(w, "#'f3.java#Box3.go'::in.call:first").collect()] == [["f0.java#Box0.go"]]
    assert results.explain(w, "#'f3.java#Box3.go'::in.call").orderBy("step").collect()[-1]["rows"] == 40
    walked = walks.walk(w, "#'f3.java#Box3.go'::in.call{1,2}").collect()
    assert len(walked) == 40 * 40 and {(r["hop"], r["via"] is None) for r in walked} == {(1, True), (2, False)}


def test_out_and_in_settle_by_rules_of_their_own(spark):
    files = [("a.go", "package a\nfunc Use(x int) { x() }\n"), ("b.go", "package b\nfunc x() {}\nfunc Far() { x() }\n")]
    w = code.workspace(spark.createDataFrame(files, "path string, content string"))
    # Use's own x is seen in Use only, the other in both files: out edges count the candidates in scope ...
    out = {(r["host"], tuple(r["far"]), r["conf"]) for r in query(w, "func::out.call").collect()}
    assert out == {("a.go#Use", ("a.go#Use.x", "b.go#x"), "unsettled"), ("b.go#Far", ("b.go#x",), "lexical")}
    # ... and in edges whether anything else has the name.
    into = {(r["host"], tuple(r["far"]), r["conf"]) for r in query(w, "#x::in.call").collect()}
    assert into == {("a.go#Use.x", ("a.go#Use",), "unsettled"), ("b.go#x", ("a.go#Use",), "unsettled"), ("b.go#x", ("b.go#Far",), "unsettled")}


def test_definitions_of_both_directions_and_outside(spark):
    files = [("a.go", "package a\nfunc Run() {}\n"), ("b.go", "package b\nfunc Run() {}\n"), ("c.go", "package c\nfunc Go1() { Run() }\nfunc Go2() { Run() }\nfunc Go3() { Run() }\n")]
    defs = [("c.go", 2, 14, "b.go", 2), ("c.go", 3, 14, "/root/go/pkg/mod/example.org/lib@v1/run.go", 7), ("c.go", 4, 14, "c.go", 99)]
    w = code.workspace(spark.createDataFrame(files, "path string, content string"), definitions=spark.createDataFrame(defs, "path string, line int, col int, def_path string, def_line int"))
    out = {r["host"]: (r["far"], r["conf"]) for r in query(w, "func::out.call").collect()}
    assert out == {"c.go#Go1": (["b.go#Run"], "lsp"), "c.go#Go2": (["example.org/lib#Run"], "external"), "c.go#Go3": (["a.go#Run", "b.go#Run"], "unsettled")}
    # A definition elsewhere means that the site isn't this one's, whatever its name.
    assert {(r["host"], tuple(r["far"]), r["conf"]) for r in query(w, "#Run::in.call").collect()} == {("b.go#Run", ("c.go#Go1",), "lsp")}
    assert nodes(w, "#Go2::out.call > *") == {"Run"} and nodes(w, ":root *") & {"Run"} == {"Run"}
    assert [r["node"] for r in query(w, "#Go2::out.call > *").collect()] == ["example.org/lib#Run"]


def test_inner_functions_are_seen_in_their_bodies(spark):
    text = "def outer():\n    def help():\n        return 1\n    def deeper():\n        return help()\n    return help()\n\n\ndef other():\n    return help()\n"
    w = code.workspace(spark.createDataFrame([("a.py", text)], "path string, content string"))
    assert nodes(w, "#'a.py#outer.help'::in.call > *") == {"outer", "outer.deeper"}
    assert nodes(w, "#other::out.call > *") == set()


def test_annotation_blocks_of_any_length(spark):
    text = "package p;\n\n@Mark\n" + "// more\n" * 200 + "class A {\n}\n\n// Mark\n\nclass B {\n  void f() {}\n}\n"
    w = code.workspace(spark.createDataFrame([("A.java", text)], "path string, content string"))
    assert nodes(w, "class:annotated('Mark')") == {"A"}
    assert nodes(w, "class:contains('void')") == {"B"} and nodes(w, "file:contains('void')") == {"A.java"}


def test_points_in_spans_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    spans = [("f" if i % 3 else "g", *sorted(rng.choices(range(1, 700), k=2)), i) for i in range(120)] + [("f", 9, 3, 120), ("f", 5, None, 121), ("g", None, None, 122)]
    points = [(rng.choice("fgh"), rng.randint(1, 720)) for _ in range(400)]
    got = intervals.within(spark.createDataFrame(spans, "path string, low int, high int, span int"), spark.createDataFrame(points, "path string, line int"), "path")
    want = [(p, line, s) for p, line in points for q, a, b, s in spans if p == q and (a is None or b is not None and a <= line <= b)]
    assert sorted((r["path"], r["line"], r["span"]) for r in got.collect()) == sorted(want)
    best = intervals.innermost(spark.createDataFrame([(p, str(s), a, b) for p, a, b, s in spans if a], "path string, span string, lo int, hi int"), spark.createDataFrame(points, "path string, line int"))
    for r in best.collect():
        around = [(b - a, -a, str(s)) for q, a, b, s in spans if q == r["path"] and a and b and a <= r["line"] <= b]
        assert r["span"] == (min(around)[2] if around else None)


def linked(spark, pairs, groups=None):
    """A workspace of functions named by number, in files of ten, with calls."""
    ids = sorted({x for p in pairs for x in p})
    rows = [(0, "project", "w", None, [0], None)] + [(1000 + f, "file", f"f{f}", 0, [0, 1000 + f], None) for f in {i // 10 for i in ids}]
    rows += [(2000 + i, "func", f"n{i}", 1000 + i // 10, [0, 1000 + i // 10, 2000 + i], None) for i in ids]
    nodes = spark.createDataFrame([(i, c, n, n, n, n, None, p, a, None, f"{i:05d}", 1, 1) for i, c, n, p, a, _ in rows], "id long, cls string, leaf string, full string, addr string, path string, lang string, parent long, anc array<long>, file_id long, ord string, start int, end int")
    calls = spark.createDataFrame([(2000 + a, 2000 + b, "call", "", "lexical", f"{a}>{b}") for a, b in pairs], "src long, dst long, kind string, pos string, conf string, site string")
    return Workspace(nodes.cache(), spark.createDataFrame([], "file_id long, line int, text string"), both_directions(calls).cache())


def test_long_chains_take_a_logarithm_of_rounds(spark, monkeypatch):
    w = linked(spark, [(i, i + 1) for i in range(400)] + [(400, 390), (7, 500), (500, 501)])
    made, write = [], closure.written
    monkeypatch.setattr(closure, "written", lambda df, *p: made.append(1) or write(df, *p))
    got = nodes(w, "func#n5::out.call{1,} > *")
    assert got == {f"n{i}" for i in [*range(6, 401), 500, 501]} and len(made) < 60
    assert nodes(w, "func#n501:parents(func)") == {f"n{i}" for i in [*range(8), 500]}
    assert nodes(w, "func#n501:parents(file)") == {"f50", "f0"}


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_against_walking(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = list({(rng.randrange(60), rng.randrange(60)) for _ in range(55)} | {(5, 5)})
    w = linked(spark, pairs)
    callers = lambda x: {a for a, b in pairs if b == x}
    every = {x for p in pairs for x in p}

    def upstream(tips):
        out, todo = set(), list(tips)
        while todo:
            x = todo.pop()
            near = {f"f{int(x[1:]) // 10}"} | {f"n{a}" for a in callers(int(x[1:]))} if x[0] == "n" else {"w"} if x[0] == "f" else set()
            todo += near - out
            out |= near
        return out

    some = [f"n{i}" for i in sorted(every)[:4]]
    up = upstream(some)
    ids = ", ".join(f"func#{s}" for s in some)
    assert nodes(w, f"*:is({ids}):parents") == up
    assert nodes(w, f"*:is({ids}):parents(func)") == {x for x in up if x[0] == "n"}
    # For each tip by itself, where a claim asks.
    assert nodes(w, "func:where(::in.call:empty)") == {f"n{x}" for x in every if not callers(x)}
    assert nodes(w, "func:parents(func):empty") == {f"n{x}" for x in every if not {y for y in upstream([f"n{x}"]) if y[0] == "n"}}


def test_sides_of_conflicts_need_neither_symbols_nor_edges(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("edges were made")

    monkeypatch.setattr(code, "_edges", refused)
    frame = spark.createDataFrame([("a/x.txt", "top\n<<<<<<< ours\nmine\n=======\ntheirs\n>>>>>>> b\n"), ("a/y.go", "package a\n\nfunc F() {}\n")], "path string, content string")
    ws = StoredWorkspace(lambda: code.workspace(frame))
    got = query(ws, "file::mine, file::theirs").select("node", "line", "text").collect()
    assert sorted(map(tuple, got)) == [("a/x.txt", 3, "mine"), ("a/x.txt", 5, "theirs")]
    assert set(ws._classes) == {"file"}


def test_returns_need_no_edges(spark):
    frame = spark.createDataFrame([("a/y.go", "package a\n\nfunc F() (int, error) { return G() }\n\nfunc G() (int, error) { return 1, nil }\n")], "path string, content string")
    ws = StoredWorkspace(lambda: code.workspace(frame))
    got = query(ws, "func > return, method > return").select("node").collect()
    assert sorted(r["node"] for r in got) == ["a/y.go#F.error", "a/y.go#F.int", "a/y.go#G.error", "a/y.go#G.int"]
    assert "_linked" not in ws._plain.__dict__


def test_annotated_needs_no_edges(spark):
    frame = spark.createDataFrame([("a/B.java", "package a;\n\n@Stored(\"b\")\npublic class B {\n  @Override\n  public void go(int a) { go(a); }\n}\n")], "path string, content string")
    ws = StoredWorkspace(lambda: code.workspace(frame))
    got = query(ws, "class:annotated('Stored'), method:annotated('@Override')").select("node").collect()
    assert sorted(r["node"] for r in got) == ["a/B.java#B", "a/B.java#B.go"]
    assert "_linked" not in ws._plain.__dict__


def test_declarations_need_no_join_with_their_files(spark):
    frame = spark.createDataFrame([("a/y.go", "package a\n\nfunc F() int { return 1 }\n"), ("x.go", "package x\n")], "path string, content string")
    symbols = code.workspace(frame.union(frame)).parts[""]
    assert "Join" not in symbols._jdf.queryExecution().optimizedPlan().toString()
    # A file that is there twice has each of its declarations twice, not four times.
    assert {tuple(r) for r in symbols.groupBy("addr").count().collect()} == {("a/y.go#a", 2), ("a/y.go#F", 2), ("a/y.go#F.int", 2), ("x.go#x", 2)}
    up = {r["addr"]: r["anc"] for r in code.workspace(frame).nodes.where("anc is not null").collect()}
    assert up["a/y.go#F"][:-1] == up["a/y.go"] and up["x.go#x"][:-1] == up["x.go"]


def test_small_files_are_parsed_into_one_batch():
    rows = [(f"a/f{i}.go", "go", f"package a\n\nfunc F{i}() {{}}\n") for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "lang", "content"])
    assert [b.num_rows for b in code._parse("decls")([batch])] == [100]


@pytest.mark.parametrize("selector", ["func::in.call", "func::out", "struct::in, method::in", "*::in"])
def test_tallies_of_folded_edges(ws, selector):
    want = query(ws, selector).groupBy("host").count()
    assert sorted(map(tuple, tally(ws, selector).select("host", "n").collect())) == sorted(map(tuple, want.collect()))
