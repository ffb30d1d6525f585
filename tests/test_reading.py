"""Walks with provenance, readings of selectors, reading text, budgets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline import tools
from treeline.functions import trigrams
from treeline.operators import read, results, text, walks
from treeline.plans.compiler import query
from treeline.plans.selector import SelectorError
from treeline.sources import code
from treeline.workspace import StoredWorkspace

CHAIN = "package p\nfunc a() { b() }\nfunc b() { c(); d() }\nfunc c() { d() }\nfunc d() { a() }\n"
OTHER = "package q\nfunc d() {}\nfunc longer() {\n\tx := 1\n\treturn\n}\n"


@pytest.fixture(scope="module")
def ws(spark):
    w = code.workspace(spark.createDataFrame([("p/a.go", CHAIN), ("q/b.go", OTHER), ("t.txt", "".join(f"line {i}\n" for i in range(1, 41)))], "path string, content string"))
    w.nodes, w.edges, w.lines = w.nodes.cache(), w.edges.cache(), w.lines.cache()
    return w


def test_hops_and_via(ws):
    rows = walks.walk(ws, "#'p/a.go#a'::out.call{1,}").collect()
    hops = {(r["host"], tuple(r["far"])): r["hop"] for r in rows}
    assert hops[("p/a.go#a", ("p/a.go#b",))] == 1 and hops[("p/a.go#b", ("p/a.go#c",))] == 2
    assert hops[("p/a.go#c", ("p/a.go#d", "q/b.go#d"))] == 3 and hops[("p/a.go#d", ("p/a.go#a",))] == 3
    by = {r["edge"]: r for r in rows}
    assert all((r["via"] is None) == (r["hop"] == 1) and (r["via"] is None or by[r["via"]]["hop"] == r["hop"] - 1) for r in rows)
    assert tuple(walks.unsettled(walks.walk(ws, "#'p/a.go#a'::out.call{1,}")).first()) == (2, 2)
    assert {r["hop"] for r in walks.walk(ws, "#'p/a.go#a'::out.call{2,3}").collect()} == {2, 3}
    with pytest.raises(SelectorError):
        walks.walk(ws, "func")


def test_inert_containments():
    assert walks.inert("func dir") and walks.inert("argument > func") and walks.inert("file file")
    assert not walks.inert("dir dir file > func, class method > argument")


def test_reading_of_a_selector():
    rows = walks.describe("dir#a > file.go::grep('x'), func:not(#b):where(::in.call{2,}):arity(1,2):first")
    assert rows[0] == (0, "every dir named 'a'") and (0, "directly below, every file in go") in rows and (0, "or") in rows
    assert (1, "but not:") in rows and (2, "every node named 'b'") in rows
    assert (1, "with 1 to 2 arguments") in rows and (1, "only the first of each") in rows
    assert any("of kind call, 2 times or more" in t for _, t in rows)
    assert "::grep" in walks.GRAMMAR


def test_addresses(spark, ws):
    asked = spark.createDataFrame([("p/a.go#a", None), ("q/b.go", 3), ("nope", None)], "addr string, line int")
    assert {(r["addr"], r["cls"]) for r in read.resolved(ws, asked).collect()} == {("p/a.go#a", "func"), ("q/b.go", "file")}


def test_reading_whole_and_in_windows(ws):
    assert [r["text"] for r in read.read(ws, "q/b.go#longer").collect()] == ["func longer() {", "\tx := 1", "\treturn", "}"]
    first = read.read(ws, "t.txt", chars=30).collect()
    assert [r["line"] for r in first] == [1, 2, 3, 4, 5][: len(first)] and first[-1]["next"] == len(first) + 1
    rest = read.read(ws, "t.txt", offset=38).collect()
    assert [r["line"] for r in rest] == [38, 39, 40] and rest[-1]["next"] is None
    with pytest.raises(SelectorError, match="no node"):
        read.read(ws, "none.go")


def test_long_lines_and_contexts_are_cut(spark):
    row = spark.createDataFrame([("x" * 400 + "HIT" + "y" * 400, 401, 3)], "t string, at int, n int")
    cut = row.select(read.capped(F.col("t"), F.col("at"), F.col("n"), 100)).first()[0]
    assert "HIT" in cut and cut.endswith("(+703 chars)") and len(cut.split(" (+")[0]) == 100
    assert spark.createDataFrame([("short",)], "t string").select(read.capped(F.col("t"), F.lit(1), F.lit(2))).first()[0] == "short"
    wide = spark.createDataFrame([(["b1" * 10, "b2"], "hit", ["a1", "a2" * 10], [], [])], "b array<string>, h string, a array<string>, e array<string>, f array<string>")
    before, after = read.budgeted(F.col("b"), F.col("h"), F.col("a"), 12)
    assert tuple(wide.select(before, after).first()) == (["b2"], ["a1"])
    before, after = read.budgeted(F.col("e"), F.col("h"), F.col("f"), 12)
    assert tuple(wide.select(before, after).first()) == ([], [])


def test_places_and_words(spark, ws):
    got = read.references_at(ws, spark.createDataFrame([("p/a.go", 2, 12)], "path string, line int, col int")).collect()
    assert {(r["name"], r["to_path"], r["to_line"]) for r in got} == {("b", "p/a.go", 2), ("b", "p/a.go", 3)}
    edited = spark.createDataFrame([("p/a.go", 3, 6)], "path string, line int, col int")
    assert {(r["line"], r["col"]) for r in read.mentions(ws, "b", edited).collect()} == {(2, 12)}
    row = spark.createDataFrame([("a😀b é", 3)], "t string, c int")
    assert row.select(read.utf16(F.col("t"), F.col("c"))).first()[0] == 4
    assert spark.createDataFrame([("  a \n\t b ",)], "t string").select(read.collapsed(F.col("t"))).first()[0] == "a b"
    assert [r["node"] for r in read.symbols_of(ws, "q/b.go").collect()] == ["q/b.go#q", "q/b.go#d", "q/b.go#longer"]
    assert read.near_names(ws, "lnger").first()["leaf"] == "longer"


def test_new_diagnostics(spark):
    old = spark.createDataFrame([("f", "e1"), ("f", "e1"), ("g", None)], "path string, message string")
    new = spark.createDataFrame([("f", "e1"), ("f", "e1"), ("f", "e1"), ("g", None), ("h", "e2")], "path string, message string")
    assert {tuple(r) for r in read.missing(old, new, ["path", "message"]).collect()} == {("f", "e1", 1), ("h", "e2", 1)}
    assert {r["path"] for r in read.sibling_diagnostics(new, spark.createDataFrame([("f",)], "path string")).collect()} == {"g", "h"}


def test_documents_of_pages_and_costs(ws):
    page = results.page(ws, "func", limit=2).document()
    assert (len(page["rows"]), page["total"], page["truncated"], page["subject"], page["hint"]) == (2, 6, True, "every func", None)
    nothing = results.page(ws, "func#lnger").document()
    assert nothing["total"] == 0 and "longer" in nothing["hint"]
    assert any("implement" in n for n in walks.notes(ws, "func::out.implements")) and walks.notes(ws, "func dir")
    costs = results.cost(ws, "dir#p > file > func")
    assert [c["rows"] for c in costs] == [1, 1, 4] and all(c["expected_bytes"] > 0 for c in costs)
    ordered = ws.nodes.where("cls = 'func'").select("path", F.col("addr").alias("node"), F.col("cls").alias("type"), "start", "end", "ord")
    assert [r["path"] for r in results.by_file(ordered).collect()] == ["p/a.go", "q/b.go"]


def test_outlines_and_sizes(ws):
    assert [tuple(r) for r in text.file_outline(ws, "p/a.go").collect()] == [("func", 4), ("module", 1)]
    assert [tuple(r) for r in text.file_outline(ws, "p/a.go", least=2).collect()] == [("func", 4)]
    assert {(r["node"], r["n"]) for r in text.tree_sizes(ws).where("type = 'dir'").collect()} == {("p", 7), ("q", 5)}


def test_tools_check_their_parameters(ws):
    assert tools.call(ws, "search", pattern="longer").count() == 1
    with pytest.raises(ValueError, match="missing: pattern"):
        tools.call(ws, "search")
    with pytest.raises(ValueError, match="unknown: colour"):
        tools.call(ws, "query", selector="func", colour=1)
    with pytest.raises(ValueError, match="no tool"):
        tools.call(ws, "nope")


def test_parse_cache(spark, tmp_path, monkeypatch):
    files = [("p/a.go", CHAIN), ("q/b.go", OTHER), ("e.go", "")]
    frame = spark.createDataFrame(files, "path string, content string")
    folder = f"file://{tmp_path}/cache"
    want = sorted(tuple(r) for r in code.workspace(frame).nodes.select("addr", "cls", "start").collect())
    for _ in range(2):
        w = code.workspace(frame, cache=folder)
        assert sorted(tuple(r) for r in w.nodes.select("addr", "cls", "start").collect()) == want
        assert w.edges.distinct().count() == code.workspace(frame).edges.distinct().count()
    keys = spark.read.parquet(f"{folder}/v{code.CACHE_VERSION}/decls/keys")
    assert keys.count() == 3
    changed = spark.createDataFrame([("p/a.go", "package p\nfunc only() {}\n"), *files[1:]], "path string, content string")
    assert {r["addr"] for r in code.workspace(changed, cache=folder).nodes.where("path = 'p/a.go' and cls = 'func'").collect()} == {"p/a.go#only"}
    keys.unpersist()
    assert spark.read.parquet(f"{folder}/v{code.CACHE_VERSION}/decls/keys").count() == 4
    assert code.workspace(spark.createDataFrame([("x.gox", "package z\nfunc f() {}\n")], "path string, content string"), extensions={"gox": "go"}).nodes.where("cls = 'func'").count() == 1


# -- trigrams and the search report -------------------------------------------
TEXTS = {"a/one.txt": "alpha beta\nLICENSE here\ngamma\n", "a/two.md": "beta\npass-word\n", "b/three.txt": "Straße ſtop Kelvin\n", "b/gen.txt": "é" * 2600 + " beta\n", "b/none.txt": None}


@pytest.fixture(scope="module")
def both(spark):
    frame = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    made = lambda: code.workspace(frame)
    return StoredWorkspace(made), StoredWorkspace(made, trigrams.index)


@pytest.mark.parametrize("grep", ["beta", "-i license", "-E alpha|pass", "-E 'be+ta'", "-v beta", "-i STOP", "-i kelvin", "-w beta", "-E 'zzz+|yyyy'", "be", "-A1 license", "-E '[[:alpha:]]{5} b'"])
def test_searches_are_the_same_with_trigrams(both, grep):
    plain, indexed = [sorted(tuple(r) for r in query(w, f"file::grep('{grep}')").collect()) if "'" not in grep else sorted(tuple(r) for r in query(w, f'file::grep("{grep}")').collect()) for w in both]
    assert plain == indexed


def test_files_without_the_trigrams_are_not_read(both):
    plan = query(both[1], "file:contains('license')")._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" in plan and "bits" not in query(both[0], "file:contains('license')")._jdf.queryExecution().optimizedPlan().toString()
    found = text.find(both[1], "beta|pass", limit=2, context=1)
    assert [(r["path"], r["line"], r["col"], r["hit"], r["text"], r["before"], r["after"]) for r in found.rows.collect()] == [("a/one.txt", 1, 7, "beta", "alpha beta", [], ["LICENSE here"]), ("a/two.md", 1, 1, "beta", "beta", [], ["pass-word"])]
    # Of five files one is generated by its bytes, one has no text, and one lacks the trigrams.
    assert (found.hits, found.dropped, found.generated, found.unread) == (3, 1, 1, 2)
    assert (text.find(both[0], "beta", glob="*.md").hits, text.find(both[0], "beta", path_prefix="a/").hits) == (1, 2)
    with pytest.raises(ValueError):
        text.find(both[0], "x", limit=0)


def test_trigrams_of_random_texts_never_hide_a_match():
    import random

    rng = random.Random(8)
    for _ in range(300):
        body = "".join(rng.choice("abcé\nXY") for _ in range(rng.randint(0, 60)))
        words = np.array(trigrams.bitmap(body), np.int64).view(np.uint64)
        has = lambda c: int(words[(c & (len(words) * 64 - 1)) >> 6]) >> (c & 63) & 1  # noqa: E731, B023
        for n in (3, 5):
            for i in range(len(body) - n + 1):
                raw = np.frombuffer(body[i : i + n].encode().lower(), np.uint8)
                assert all(map(has, trigrams._hash(raw).tolist()))


def test_globs():
    import re

    names = ["a.go", "b_test.go", "x[1].go", "a.py", "ab"]
    hits = lambda g: [n for n in names if re.match(text.glob_regex(g), n)]
    assert hits("*.go") == names[:3] and hits("?.go") == ["a.go"] and hits("[^a]*.go") == ["b_test.go", "x[1].go"] and hits(r"x\[1].go") == ["x[1].go"] and hits("[ab]?") == ["ab"]
