"""Bindings, schemas, git, patches, the older selector form, quotes, stateful forms."""

from __future__ import annotations

import datetime
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from treeline.operators import patches
from treeline.plans import legacy
from treeline.plans.selector import SelectorError, parse, repaired
from treeline.sources import bindings, code, git
from treeline.streaming import state

API = json.dumps({"openapi": "3.0", "paths": {"/x": {"get": {"operationId": "listCrates"}, "parameters": []}}, "components": {"schemas": {"Crate": {}}}}, indent=1)
PROTO = "// message No {}\nmessage Crate { string id = 1; }\nservice Stock { rpc Find (Crate) returns (Crate); }\n"
GO = 'package p\n\ntype Crate struct {\n\tShelf string `derived:"crates.shelf_name"`\n}\n\nfunc find() { call("listCrates") }\n'
FILES = [("api.yaml", API), ("s.proto", PROTO), ("p.go", GO), ("v.schema.json", '{"title": "View", "properties": {"width": {}}, "$defs": {"Edge": {}}}'), ("conf.json", '{"a": [{"b": "shelf"}, {"b": 7}]}'), ("res/l.xml", '<r>\n<V id="@+id/box"/>\n<string name="hello">x</string>\n</r>'), ("A.java", "class A {\n  int x = R.id.box + R.string.hello + R.id.none;\n}\n"), ("plain.json", '{"k": 1}')]
CONFIG = """
languages: {go: [.go]}
bindings:
  - name: shelf
    sites:
      - {file: conf.json, jsonpath: "$.a[*].b"}
      - {file: p.go, symbol: Crate.Shelf}
      - {file: p.go, regex: "shelf_\\\\w+"}
      - {file: gone.go, symbol: X}
      - {file: p.go, regex: "(a)\\\\1"}
schemas:
  - {file: api.yaml, type: openapi}
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string").cache()


@pytest.fixture(scope="module")
def ws(files):
    w = code.workspace(files)
    w.nodes, w.edges, w.lines = w.nodes.cache(), w.edges.cache(), w.lines.cache()
    return w


def test_json_paths():
    data = {"a": [{"b": 1}, {"b": [2, 3]}], "c d": {"e": 4}}
    assert bindings.walk_path(data, "$.a[*].b") == [1, [2, 3]] and bindings.walk_path(data, "$.a[1].b[0]") == [2]
    assert bindings.walk_path(data, "$['c d'].e") == [4] and bindings.walk_path(data, "$.x.y") == [] and bindings.walk_path(data, "$.*") == [data["a"], data["c d"]]
    with pytest.raises(ValueError):
        bindings.walk_path(data, "a")


def test_declared_sites(spark, files, ws):
    pytest.importorskip("yaml")
    told = bindings.config(spark, CONFIG)
    found, failed = bindings.applied(ws, files, told["sites"])
    assert {(r["name"], r["path"], r["line"]) for r in found.collect()} == {("shelf", "conf.json", 1), ("shelf", "p.go", 4)}
    assert {(r["path"], r["why"]) for r in failed.collect()} == {("gone.go", "no such file"), ("p.go", "the pattern can't be read")}
    assert [tuple(r) for r in told["schemas"].collect()] == [("api.yaml", "openapi")]
    assert {r["name"] for r in bindings.regex_names(ws, r"type (\w+)", r"\.go$").collect()} == {"Crate"}


def test_schemas_and_promotion(files, ws):
    found = bindings.entities(files)
    assert {(r["path"], r["name"], r["kind"]) for r in found.collect()} == {("api.yaml", "listCrates", "operation"), ("api.yaml", "Crate", "schema"), ("s.proto", "Crate", "message"), ("s.proto", "Stock", "service"), ("s.proto", "Find", "rpc"), ("v.schema.json", "View", "schema"), ("v.schema.json", "Edge", "schema"), ("v.schema.json", "width", "property")}
    sites = {(r["path"], r["conf"]) for r in bindings.promoted(ws, found.where("name = 'Crate'")).collect()}
    assert ("s.proto", "declared") in sites and ("p.go", "promoted") in sites
    assert {(r["path"], r["line"]) for r in bindings.derived_operations(ws, found.where("kind = 'operation'")).collect()} == {("p.go", 7)}
    assert bindings.schema_kind("x.json", '{"$schema": "u"}') == "jsonschema" and bindings.schema_kind("x.json", "[1]") is None and bindings.schema_kind("x.go", "{}") is None


def test_resources_and_columns(spark, ws):
    assert {(r["kind"], r["name"], r["line"], r["used_line"]) for r in bindings.resource_links(ws).collect()} == {("id", "box", 2, 2), ("string", "hello", 3, 2)}
    columns = spark.createDataFrame([("crates", "shelf_name"), ("crates", "gone")], "table string, column string")
    assert [(r["column"], r["path"], r["line"]) for r in bindings.derived_columns(ws, columns).collect()] == [("shelf_name", "p.go", 4)]
    shared = spark.createDataFrame([("a", 2), ("b", 2)], "leaf string, n_dirs long")
    assert [r["leaf"] for r in bindings.coupled(shared, spark.createDataFrame([("a",)], "name string")).collect()] == ["b"]


def test_git_branches(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "trunk")
    (tmp_path / "a b.go").write_text("package a\n")
    (tmp_path / "bin").write_bytes(b"\0")
    (tmp_path / ".gitignore").write_text("*.log\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("branch", "side")
    run("checkout", "-q", "side")
    run("branch", "--set-upstream-to=trunk")
    (tmp_path / "a b.go").write_text("package b\n")
    run("commit", "-qam", "two")
    assert git.branch_chain(str(tmp_path), "side") == ["side", "trunk"]
    assert {(r["path"], r["content"]) for r in git.blobs(spark, str(tmp_path), "trunk").collect()} == {("a b.go", "package a\n"), (".gitignore", "*.log\n")}
    run("checkout", "-q", "trunk")
    (tmp_path / "a b.go").write_text("package c\n")
    run("commit", "-qam", "three")
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", "merge", "-q", "side"], capture_output=True, check=False)
    assert git.unmerged(str(tmp_path)) == ["a b.go"] and git.ignore_lines(str(tmp_path)) == ["*.log"]
    with pytest.raises(ValueError):
        git.paths(str(tmp_path), "nowhere")


DIFF = "--- a\n+++ b\n@@ -2,3 +2,4 @@\n two\n-three\n+3\n+3.5\n four\n@@ -6,1 +7,0 @@\n-six\n"


def test_diffs(spark, tmp_path):
    text = "one\ntwo\nthree\nfour\nfive\nsix\nseven\n"
    want = "one\ntwo\n3\n3.5\nfour\nfive\nseven\n"
    assert patches.apply_diff(text, DIFF) == want
    assert patches.apply_diff("zero\n" + text, DIFF) == "zero\n" + want
    for bad in ("", "@@ -1,1 +1,1 @@\n-nope\n+x"):
        with pytest.raises(ValueError):
            patches.apply_diff(text, bad)
    rows = spark.createDataFrame([(text, DIFF), (text, "x"), (None, DIFF)], "t string, d string")
    assert [r[0] for r in rows.select(patches.patched(F.col("t"), F.col("d"))).collect()] == [want, None, None]
    patches.write_atomic(str(tmp_path / "f"), "a\r\nb")
    assert (tmp_path / "f").read_bytes() == b"a\r\nb" and len(list(tmp_path.iterdir())) == 1


def test_moved_files(spark):
    files = spark.createDataFrame([("web/a.ts", "import {x} from './lib/u';\nimport y from './other';\n"), ("web/lib/u.ts", "import z from '../other';\nimport p from 'pkg';\n"), ("web/lib/v.js", "const q = require('./u.ts');\n")], "path string, content string")
    got = {(r["path"], r["old"], r["new"], r["action"]) for r in patches.move_plan(files, "web/lib/u.ts", "web/core/deep/w.ts").collect()}
    assert got == {("web/a.ts", "./lib/u", "./core/deep/w", "edit"), ("web/lib/u.ts", "../other", "../../other", "edit"), ("web/lib/v.js", "./u.ts", "../core/deep/w.ts", "edit"), ("web/lib/u.ts", "web/lib/u.ts", "web/core/deep/w.ts", "move")}


def test_signatures(spark, ws):
    files = spark.createDataFrame([("a.go", 'package a\nfunc put(k string, n int) {}\nfunc t() { put("x, y", f(1, 2)); s.put(a, b); put(all...); put(1) } // put(c, d)\n')], "path string, content string")
    plan = patches.signature_plan(ws, files, "put", ["k string", "n int"], ["n int", "ok bool", "e error"], "go")
    got = {(r["line"], r["old"], r["new"], r["action"]) for r in plan.collect()}
    assert got == {(3, '"x, y", f(1, 2)', "f(1, 2), false, nil", "edit"), (3, "a, b", "b, false, nil", "edit"), (3, "all...", "all...", "candidate"), (3, "1", "1", "candidate")}


@pytest.mark.parametrize(("type_", "lang", "want"), [("int", "go", "0"), ("*T", "go", "nil"), ("T", "go", "T{}"), ("string", "go", '""'), ("number", "typescript", "0"), ("A[]", "typescript", "[]"), ("T", "typescript", "undefined"), ("list[int]", "python", "[]"), ("T", "python", "None"), ("boolean", "java", "false"), ("String", "java", "null"), ("String", "kotlin", '""'), ("Int?", "kotlin", "null"), ("char *", "c", "NULL")])
def test_empty_values(type_, lang, want):
    assert patches.zero_value(type_, lang) == want


def test_variance_and_comments(spark, ws):
    sites = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "path string, line int, derived boolean")
    assert [[r["action"] for r in patches.variance(sites, m).orderBy("line").collect()] for m in ("strict", "follow", "warn")] == [["refuse", "edit"], ["edit", "edit"], ["note", "edit"]]
    with pytest.raises(ValueError):
        patches.variance(sites, "x")
    assert {(r["path"], r["line"]) for r in patches.comment_mentions(ws, "No").collect()} <= {("s.proto", 1)}


def test_older_form(ws):
    names = lambda s, **k: [r["node"].split("#")[1] for r in legacy.query(ws, "p.go", s, **k).collect()]
    assert names("struct[name=Crate] > field") == ["Crate.Shelf"]
    assert names("*:depth(1)") == ["p", "Crate", "find"] and names("*:depth(2,)") == ["Crate.Shelf", "Crate.Shelf.derived"]
    assert names("struct:has(field), func") == ["Crate", "find"] and names("*", limit=2) == ["p", "Crate"]
    for bad in ("", "fnc", "func[path=x]", "func,", "func:has(field", "a)"):
        with pytest.raises(SelectorError):
            legacy.parse(bad)


@pytest.mark.parametrize(("typed", "want", "notes"), [("#'a''b'", "#'ab'", 1), ("file::grep('it'\"'\"'s')", "file::grep(\"it's\")", 1), ("file::grep('\"foo\"')", "file::grep('foo')", 1), ("file::grep('-i \"foo bar\"')", "file::grep('-i foo bar')", 1), ("func#x", "func#x", 0), (r"#'a'\''b'", "#\"a'b\"", 1)])
def test_quotes_are_put_together(typed, want, notes):
    text, told = repaired(typed)
    assert (text, len(told)) == (want, notes)
    parse(typed)


T0 = datetime.datetime(2024, 1, 1)


def ms(n):
    return T0 + datetime.timedelta(milliseconds=n)


def test_settled_values(spark, tmp_path):
    rows = [("a", ms(0), "1"), ("a", ms(100), "2"), ("a", ms(400), "3"), ("b", ms(0), "x"), ("z", ms(10_000), "end")]
    frame = spark.createDataFrame(rows, "path string, ts timestamp, v string")
    batch = {tuple(r) for r in state.settled(frame, "path", "ts", 150).collect()}
    assert batch == {("a", ms(100), "2")}
    for n in (0, 1):
        part = frame if n == 0 else spark.createDataFrame([("z", ms(20_000), "more")], frame.schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = state.settled_stream(stream, "path", "ts", "v", 150).writeStream.outputMode("append").format("memory").queryName("settled").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {tuple(r) for r in spark.table("settled").collect()}
    assert batch <= got and got <= batch | {("a", ms(400), "3"), ("b", ms(0), "x"), ("z", ms(10_000), "end")}


def test_transitions(spark, tmp_path):
    rows = [("a", ms(0), False), ("a", ms(1), True), ("a", ms(2), True), ("a", ms(3), False), ("b", ms(0), True), ("b", ms(1), None)]
    frame = spark.createDataFrame(rows, "path string, ts timestamp, bad boolean")
    want = {("a", ms(1), True), ("a", ms(3), False), ("b", ms(0), True)}
    assert {tuple(r) for r in state.transitions(frame, "path", "ts", "bad").collect()} == want
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = state.transitions_stream(stream, "path", "ts", "bad").writeStream.outputMode("append").format("memory").queryName("turns").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {tuple(r) for r in spark.table("turns").collect()} == want


def test_generations_memos_and_idle_roots(spark):
    now = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "path string, gen int")
    was = spark.createDataFrame([("a", 1), ("b", 2)], "path string, gen int")
    assert {r["path"] for r in state.sibling_rollup(now, was).collect()} == {"a", "c"}
    assert {r["path"] for r in state.sibling_rollup(now, was, edited=["a"]).collect()} == {"c"}
    memo, made = state.Memo(2), []
    make = lambda x: lambda: made.append(x) or x
    assert [memo.get("k", 1, make("v1")), memo.get("k", 1, make("v2")), memo.get("k", 2, make("v3"))] == ["v1", "v1", "v3"]
    memo.get("l", 1, make("l"))
    memo.get("m", 1, make("m"))
    assert memo.get("k", 2, make("again")) == "again" and made == ["v1", "v3", "l", "m", "again"]
    events = spark.createDataFrame([("r", ms(0), "open"), ("r", ms(5), "close"), ("s", ms(0), "open"), ("t", ms(0), "open"), ("t", ms(1), "close"), ("t", ms(900), "use")], "root string, ts timestamp, kind string")
    assert [r["root"] for r in state.idle(events, ms(1000), 500).collect()] == ["r"]
