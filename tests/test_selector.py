from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from treeline import catalog
from treeline.functions.patterns import grep_regex
from treeline.operators import incremental, text
from treeline.plans.compiler import Compiler, query, tally
from treeline.plans.selector import Grep, SelectorError, normalise, parse
from treeline.sources import tables
from treeline.workspace import StoredWorkspace, Workspace

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bad", ["", "fucn", "func:first:last", "func:bogus", "file[path]", "::in{0,2}", "*{3,1}", "func:where", "a#", "'x", "::grep('-E -F x')"])
def test_refused(bad):
    with pytest.raises(SelectorError):
        parse(bad)


def test_nearest_tag_is_named():
    with pytest.raises(SelectorError, match="'func'"):
        parse("funk")


def test_colons_are_repaired_outside_quotes():
    assert normalise("func::has(in) :grep(':in')") == "func:any(in) ::grep(':in')"


def test_patterns_have_re2_meaning(spark):
    rows = spark.createDataFrame([("naïve foo",), ("x",), ("1",), ("a.b",)], "t string")
    hit = lambda g: {r["t"] for r in rows.where(F.col("t").rlike(grep_regex(g))).collect()}
    assert hit(Grep(r"\bve\b", regex=True)) == {"naïve foo"}
    assert hit(Grep("^[[:alpha:]]$", regex=True)) == {"x"}
    assert hit(Grep("a.b")) == {"a.b"}
    with pytest.raises(SelectorError):
        grep_regex(Grep(r"(a)\1", regex=True))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values))
    assert rows(got) == rows(want)


def test_search_columns(spark):
    ws = tables.documents(spark, SF)
    ws.lines = spark.createDataFrame([(1, 1, "ab xab ab")], "file_id long, line int, text string")
    ws.nodes = ws.nodes.limit(0).unionByName(ws.nodes.where("cls = 'file'").limit(1).withColumn("file_id", F.lit(1).cast("long")))
    assert [(r["col"], r["hit"]) for r in text.search(ws, "ab").orderBy("col").collect()] == [(1, "ab"), (5, "ab"), (8, "ab")]


def test_fold_keeps_the_last_definition(spark):
    log = [(1, "create", "user", "id"), (1, "create", "user", "name"), (1, "create", "user", "old"), (2, "add", "user", "nick"), (2, "drop", "user", "old"), (3, "add", "ghost", "x"), (4, "create", "gone", "y"), (5, "drop_table", "gone", None)]
    out = incremental.fold(spark.createDataFrame(log, "seq int, op string, table string, column string")).collect()
    assert {(r["table"], r["column"], r["seq"]) for r in out} == {("user", "id", 1), ("user", "name", 1), ("user", "nick", 2)}


def test_innermost_span(spark):
    spans = spark.createDataFrame([("f", "a", 1, 20), ("f", "a.b", 5, 9), ("g", "z", 1, 2)], "path string, span string, lo int, hi int")
    points = spark.createDataFrame([("f", 6), ("f", 15), ("f", 30), ("h", 1)], "path string, line int")
    assert {(r["path"], r["line"], r["span"]) for r in text.innermost(spans, points).collect()} == {("f", 6, "a.b"), ("f", 15, "a"), ("f", 30, None), ("h", 1, None)}


def test_outline_has_every_node_of_the_tables(spark):
    out = catalog.queries()["q_structure_all"](spark, SF).groupBy("type").count().collect()
    rows = lambda *names: sum(spark.read.parquet(f"{SF}/{n}.parquet").count() for n in names)
    assert {r["type"]: r["count"] for r in out} == {"dir": rows("region", "nation") + 1, "file": rows("customer", "supplier"), "struct": rows("orders"), "field": rows("lineitem"), "type": rows("part")}


def made_for(spark, selector):
    """A result and the classes and edges that a stored workspace made for it."""
    ws = StoredWorkspace(lambda: tables.trade(spark, SF))
    found = query(ws, selector)
    return found, set(ws._classes), set(ws._asked)


def test_descendants_make_only_their_classes(spark):
    assert made_for(spark, "dir#ASIA struct")[1:] == ({"dir", "struct"}, set())


def test_groups_make_only_their_classes(spark):
    assert made_for(spark, "(dir dir){1}")[1:] == ({"project", "dir"}, set())


def test_depths_below_the_project_need_no_join(spark):
    found, _, asked = made_for(spark, "(*){3,}")
    rows = {r["node"] for r in found.collect()}
    assert rows == {r["addr"] for r in tables.trade(spark, SF).nodes.where("size(anc) > 3").collect()} and not asked
    assert Compiler(StoredWorkspace(lambda: tables.trade(spark, SF))).filtered(parse("(*){3,}")[0]) is not None


@pytest.mark.parametrize("selector", ["(*){3,}", "*{2}", "(dir){2}", "dir#ASIA > *{2,}", "dir#ASIA (*){2,}", "dir#ASIA *{0,1}", "dir#EUROPE > *{1,2}", "dir > *", "* > field", "*:root", "dir *{0,2}", "file[name^=Supplier]::in.call", "field#l1::out, type::in", "struct > *::out.type > *"])
def test_what_is_left_out_changes_no_result(spark, selector):
    whole = tables.trade(spark, SF)
    columns = ["node", "type"] if "::" not in selector or ">" in selector else ["edge", "host", "far"]
    rows = lambda ws: sorted(map(tuple, query(ws, selector).select(*columns).collect()))
    assert rows(StoredWorkspace(lambda: tables.trade(spark, SF))) == rows(Workspace(whole.nodes, whole.lines, whole.edges))


def test_edges_in_are_made_by_kind(spark):
    found, classes, asked = made_for(spark, "file[name^=Supplier]::in.call")
    assert found.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert (classes, asked) == ({"file"}, {("in", ("call",))})


def test_depth_ranges_leave_out_classes_too_far_below(spark):
    found, classes, asked = made_for(spark, "dir#EUROPE > *{1,2}")
    assert "field" not in classes and not asked
    assert {r["type"] for r in found.select("type").distinct().collect()} == {"dir", "file"}


@pytest.mark.parametrize("selector", ["file[name^=Supplier]::in.call", "field#l1::out", "type::in, file::in"])
def test_tallies_count_the_edges_found(spark, selector):
    ws = StoredWorkspace(lambda: tables.trade(spark, SF))
    want = query(ws, selector).groupBy("host").count()
    assert sorted(map(tuple, tally(ws, selector).select("host", "n").collect())) == sorted(map(tuple, want.collect()))


def test_tallies_look_up_no_far_ends(spark):
    assert not any("orders.parquet" in f for f in catalog.queries()["q_in_call"](spark, SF).inputFiles())
    with pytest.raises(SelectorError):
        tally(tables.trade(spark, SF), "file[name^=Supplier]::in.call > field")


def test_depths_below_the_project_store_no_nodes(spark):
    found, classes, _ = made_for(spark, "(*){3,}")
    assert not classes
    ws = StoredWorkspace(lambda: tables.trade(spark, SF))
    query(ws, "dir#ASIA struct").count()
    assert sorted(r["node"] for r in query(ws, "(*){3,}").collect()) == sorted(r["node"] for r in found.collect())


ODD_TEXTS = {
    "line ends": [(1, "the a\nthe b\n", "s"), (2, "x\n", "s"), (3, "the\n\n", "s"), (4, "the", "s"), (5, "\n", "s")],
    "no text": [(1, "", "s"), (2, None, "s"), (3, "the", "s")],
    "carriage returns": [(1, "the a\r\nLicense b\r\nc\r\n", "s"), (2, "the\r\nx\r\r", "s"), (3, "\r", "s")],
    "an id in two sources": [(1, "the\nx", "s"), (1, "y License", "t"), (2, "the", "t")],
    "repeated rows": [(1, "the\nx", "s"), (1, "the\nx", "s"), (2, "y\nz", "s")],
    "repeated ids": [(1, "the\nx", "s"), (1, "the\nthe\ny", "s")],
}


@pytest.mark.parametrize("odd", sorted(ODD_TEXTS))
def test_greps_of_odd_texts_match_their_sql(spark, tmp_path, odd):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in ODD_TEXTS[odd]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    # Where ids repeat, the order of their lines is open: no context then.
    framed = [] if odd.startswith("repeated") else ["q_grep_context", "q_near_context"]
    for name in ("q_grep_first", "q_grep_lines", "q_grep_rollup", "q_capped_lines", *framed):
        want = con.sql(catalog.oracle_sql()[name]).df()
        got = catalog.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
        assert sorted(map(repr, got.astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist())), name
