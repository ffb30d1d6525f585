"""Declarations by scan, conflicts, comment references, pages."""

from __future__ import annotations

import json

import pytest

from treeline.operators import conflicts, edits, references, results, text
from treeline.plans.compiler import query
from treeline.plans.selector import SelectorError
from treeline.sources import code, languages

JAVA = "package a.b;\nimport java.util.List;\n\npublic class Foo extends Bar {\n  private final int count = 0;\n  public Foo(int n) { this.count = n; }\n  public List<String> names(String a, Map<K, V> b) throws E {\n    if (a == null) { return null; }\n    int local = 1;\n    return x(a);\n  }\n  enum Color { RED, GREEN(1); int k; }\n}\nrecord P(int x) { }\n"
KOTLIN = "package demo\nimport a.b.C as D\n\ndata class User(val id: Int)\nfun String.shout(n: Int): String = this\nclass Repo {\n  val size: Int = 1\n  fun find(id: Int): User? {\n    val x = 1\n    return null\n  }\n}\n"
CPP = "#include <x.h>\ntypedef unsigned int uint;\nnamespace n {\nclass W { public: W(int z); void go() const; int f_; };\nenum E { ONE = 1, TWO };\n}\nstatic int add(int a, const char *b) { return a; }\nint proto(int);\n"
SQL = "-- users\nCREATE TABLE users (\n  id int primary key,\n  price numeric(10,2),\n  CONSTRAINT c CHECK (id > 0)\n);\nCREATE INDEX ix ON users(id);\ncreate or replace function f(a int) returns int as 'x;y';\n"
MD = "pre\n# A\nx `span_name` prose\n## B\n```\n# no\nfenced_name()\n```\n# C #\n"
XML = '<r xmlns:a="u">\n <string name="hi">x</string>\n <View a:id="@+id/box">\n  <T a:id="@+id/lbl" ref="@id/box"/>\n </View>\n</r>'
MERGED = "one\n<<<<<<< HEAD\nmine 1\nmine 2\n||||||| base\nold\n=======\n>>>>>>> feature/x\ntwo\n<<<<<<< lost\n<<<<<<< HEAD\na\n=======\nb\n>>>>>>> other\n========\n"
NOTES = "// @see Foo#names and {@link pkg/x.ts!Helper}\n// @ref https://example.com/Nope\nx-source: db/users.go:Users,\n// @see main.go:42:18\nUsers Foo\n"


@pytest.fixture(scope="module")
def ws(spark):
    files = [("src/Foo.java", JAVA), ("k/R.kt", KOTLIN), ("c/w.cpp", CPP), ("db/s.sql", SQL), ("README.md", MD), ("res/l.xml", XML), ("m.txt", MERGED), ("n.txt", NOTES), ("empty.java", ""), ("bad.xml", "<a><b name='kept'></b><c")]
    of = spark.createDataFrame([("src/Foo.java", "Foo", "k/R.kt", "Repo"), ("src/Foo.java", "Nope", "k/R.kt", "Repo")], "path string, sym string, of_path string, of_sym string")
    return code.workspace(spark.createDataFrame(files, "path string, content string"), implements=of)


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("java", JAVA, {"b": "module", "List": "import", "Foo": "class", "Foo.count": "field", "Foo.Foo": "ctor", "Foo.Foo.n": "argument", "Foo.names": "method", "Foo.names.a": "argument", "Foo.names.b": "argument", "Foo.Color": "enum", "Foo.Color.RED": "const", "Foo.Color.GREEN": "const", "Foo.Color.k": "field", "P": "struct"}),
        ("kotlin", KOTLIN, {"demo": "module", "D": "import", "User": "struct", "String.shout": "method", "String.shout.n": "argument", "Repo": "class", "Repo.size": "field", "Repo.find": "method", "Repo.find.id": "argument"}),
        ("cpp", CPP, {"uint": "type", "n": "module", "n.W": "class", "n.W.W": "ctor", "n.W.W.z": "argument", "n.W.go": "method", "n.W.f_": "field", "n.E": "enum", "n.E.ONE": "const", "n.E.TWO": "const", "add": "func", "add.a": "argument", "add.b": "argument"}),
        ("sql", SQL, {"users": "struct", "users.id": "field", "users.price": "field", "ix": "type", "f": "func"}),
        ("markdown", MD, {"A": "heading", "A.B": "heading", "C": "heading"}),
        ("xml", XML, {"hi": "const", "box": "field", "box.lbl": "field"}),
        ("java", "", {}),
        ("java", "class X { void f() { ", {"X": "class", "X.f": "method"}),
    ],
)
def test_declarations(lang, text, want):
    assert {d[0]: d[1] for d in languages.read(text, lang)} == want


def test_spans():
    spans = {d[0]: d[3:5] for d in languages.read(JAVA, "java")}
    assert spans["Foo"] == (4, 13) and spans["Foo.names"] == (7, 11)
    assert {d[0]: d[3:5] for d in languages.read(MD, "markdown")} == {"A": (2, 8), "A.B": (4, 8), "C": (9, 9)}


def test_markdown_names_leave_prose_out():
    assert languages.markdown_names(MD) == [("A", 2, 3), ("span_name", 3, 4), ("B", 4, 4), ("no", 6, 3), ("fenced_name", 7, 1), ("C", 9, 3)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("class#Foo > method", {"src/Foo.java#Foo.names"}),
        ("heading#A > heading", {"README.md#A.B"}),
        (".sql struct > field", {"db/s.sql#users.id", "db/s.sql#users.price"}),
        ("method:arity(2)", {"src/Foo.java#Foo.names"}),
        ("file#'bad.xml' > *", {"bad.xml#kept"}),
        ("class#Foo::out.implements > *", {"k/R.kt#Repo"}),
        ("class#Repo::in.implements > *", {"src/Foo.java#Foo"}),
    ],
)
def test_selected(ws, selector, want):
    assert {r["node"] for r in query(ws, selector).collect()} == want


def test_implements_is_crossed_only_by_name(ws):
    assert "::out.implements" not in {r["type"] for r in query(ws, "class#Foo::out").collect()}


def test_conflict_regions_and_sides(ws):
    rows = lambda s: sorted((r["line"], r["text"]) for r in query(ws, s).collect())
    assert [line for line, _ in rows("file::conflict")] == [2, 11]
    assert rows("file::conflict")[1][1] == "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> other"
    assert rows("file::mine") == [(3, "mine 1\nmine 2"), (12, "a")]
    assert rows("file::theirs") == [(2, ""), (14, "b")] == rows("file::conflict::theirs")
    assert rows("file::base") == [(6, "old")]
    assert {r["label"] for r in conflicts.fragments(ws.lines, "theirs").collect()} == {"feature/x", "other"}


@pytest.mark.parametrize(("side", "want"), [("mine", "one|mine 1|mine 2|two|<<<<<<< lost|a|========"), ("theirs", "one|two|<<<<<<< lost|b|========"), ("base", "one|old|two|<<<<<<< lost|========")])
def test_file_as_one_side_has_it(ws, side, want):
    file = ws.nodes.where("addr = 'm.txt'").select("file_id")
    lines = ws.lines.join(file, "file_id", "left_semi")
    assert "|".join(r["text"] for r in conflicts.resolved(lines, side).orderBy("line").collect()) == want


def test_spans_cut_by_a_conflict_are_withheld(spark, ws):
    file = ws.nodes.where("addr = 'm.txt'").first()["file_id"]
    spans = spark.createDataFrame([(file, 1, 1, "clear"), (file, 1, 3, "cut"), (file, 1, 16, "around"), (file, 12, 12, "inside")], "file_id long, start int, end int, name string")
    kept, held = conflicts.clear_of_conflicts(spans, ws.lines)
    assert {r["name"] for r in kept.collect()} == {"clear", "around"}
    assert {r["name"] for r in held.collect()} == {"cut", "inside"}


def test_line_diff(spark):
    assert conflicts.line_diff(["a", "b", "c"], ["b", "x", "c"]) == "- a\n  b\n+ x\n  c"
    assert conflicts.line_diff([], ["x"]) == "+ x" and conflicts.line_diff([], []) == ""
    row = spark.createDataFrame([("a\nb", "b"), (None, "x")], "m string, t string")
    assert [r[0] for r in row.select(conflicts.diff_column(row.m, row.t)).collect()] == ["- a\n  b", None]


def test_comment_references(ws):
    got = {(r["line"], r["name"], r["conf"]) for r in references.comment_refs(ws).where("path = 'n.txt'").collect()}
    assert got == {(1, "names", "comment"), (1, "Helper", "comment"), (3, "Users", "declared")}
    assert {(r["name"], r["n_sites"]) for r in references.bindings(ws).collect()} == {("Users", 2)}
    assert {(r["line"], r["conf"]) for r in references.occurrences(ws, "Users").collect()} == {(3, "declared"), (5, "lexical")}
    assert {r["name"] for r in references.workspace_symbols(ws, "SPAN").collect()} == {"span_name"}


def test_pages(ws):
    page = results.page(ws, "heading", limit=2)
    assert [r["node"] for r in page.rows.collect()] == ["README.md#A", "README.md#A.B"] and page.total() == 3
    assert [json.loads(r["json"])["node"] for r in results.page(ws, "heading", offset=2).json().collect()] == ["README.md#C"]
    assert results.as_text(page.rows).first()["text"] == "README.md\n├─ heading A @2-8\n└─ heading A.B @4-8"
    with pytest.raises(SelectorError):
        results.page(ws, "heading", limit=-1)


def test_explain_and_hint(ws):
    assert [(r["step"], r["rows"]) for r in results.explain(ws, "class#Foo > method").orderBy("step").collect()] == [(1, 1), (2, 1)]
    assert results.hint(ws, "class#Foo > method") is None
    assert "drop the tag" in results.hint(ws, "func#Repo")
    assert results.hint(ws, "class#Foo > func").startswith("step 2 finds nothing; the steps before")


def test_rename_plan(ws):
    plan = edits.rename_plan(ws, "Repo", "Store")
    assert {(r["path"], r["line"], r["col"], r["action"]) for r in plan.collect()} == {("k/R.kt", 6, 7, "edit")}
    assert [(r["before"], r["after"]) for r in edits.applied(ws, plan).collect()] == [("class Repo {", "class Store {")]
    assert {r["action"] for r in edits.rename_plan(ws, "id", "key").where("path = 'db/s.sql' and line = 7").collect()} <= {"edit", "candidate"}
    with pytest.raises(ValueError):
        edits.rename_plan(ws, "a b", "c")


def test_edits_of_one_line_go_from_the_right(spark, ws):
    plan = spark.createDataFrame([("m.txt", 3, 1, "mine", "ours", "edit"), ("m.txt", 3, 6, "1", "one", "edit"), ("m.txt", 4, 1, "gone", "x", "edit"), ("m.txt", 9, 1, "two", "x", "candidate")], "path string, line int, col int, old string, new string, action string")
    assert [(r["line"], r["after"]) for r in edits.applied(ws, plan).collect()] == [(3, "ours one")]


def test_structure(ws):
    names = lambda **k: [r["node"] for r in text.structure(ws, **k).collect()]
    assert names(pattern="^Color$") == ["src", "src/Foo.java", "src/Foo.java#Foo", "src/Foo.java#Foo.Color", "src/Foo.java#Foo.Color.RED", "src/Foo.java#Foo.Color.GREEN", "src/Foo.java#Foo.Color.k"]
    assert names(folder="db", depth=1) == ["db", "db/s.sql"]
    assert len(names(limit=3)) == 3
