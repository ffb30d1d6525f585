"""Odd input: very long values, ties, repeated rows, empty tables, columns of clashing names."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from treeline.llm import decontaminate, htmltext, minhash, quality, urlfilter, vptree

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    index = urlfilter.publish(spark, [("a.b/x/", "block"), ("b/x/", "allow"), ("b/x/y", "block"), ("a.b/x/", "allow")])
    long = "http://a.b/x/" + "p/" * 100_000
    rows = [(1, "http://a.b/x/z", "h"), (1, "http://a.b/x/z", "h"), (2, "http://b/x/y/z", "h"), (3, long, "h"), (None, "http://c.b/x/", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("rule", F.lit(1)).withColumn("id", F.lit("q"))
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, index).collect()), key=str)
    assert got == sorted([(1, "a.b/x/", "block"), (1, "a.b/x/", "block"), (2, "b/x/y", "block"), (3, "a.b/x/", "block"), (None, "b/x/", "allow")], key=str)
    assert urlfilter.filter_urls(df.limit(0), index).collect() == []


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "word " * 200_000 + item + " end"
    rows = [(1, f"{item} x {item}"), (1, f"{item} x {item}"), (2, long), (None, item), (3, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("i")).withColumn("edits", F.lit(1))
    bench = spark.createDataFrame([(7, item), (7, item), (8, item.upper())], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, bench).distinct().collect()), key=str)
    assert got == sorted([(d, i, 0) for d in (1, 2, None) for i in (7, 8)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]
    assert decontaminate.leaks(docs.limit(0), bench).collect() == [] and decontaminate.clean(docs.limit(0), bench).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Same, text.</p></article>", "t")] * 2, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("n"))
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and [r["text"] for r in out.collect()] == ["Same, text."] * 2
    assert htmltext.extract(df.limit(0)).collect() == []


def test_near_copies_of_equal_and_clashing_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words of the same id here"), (9, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("component", F.lit("c")).withColumn("root", F.lit(2))
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, k=5).collect())
    assert [(d, c, k) for d, _, c, k in got] == [(5, 5, True), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_nearest_of_an_empty_side(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], "vec_id long, embedding array<double>")
    assert vptree.nearest(df, df.limit(0)).collect() == [] and vptree.nearest(df.limit(0), df).collect() == []
    assert [tuple(r) for r in vptree.nearest(df, df.where("vec_id = 1"), 5).collect()] == [(1, 1, 2, 0.5)]


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name in ("score", "n_lines", "key", "ids", "row", "component", "__own"):
        docs = docs.withColumn(name, F.lit(name))
    one = docs.limit(1)
    long = one.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))))).withColumn("doc_id", F.lit(10**9).cast("long"))
    return docs.unionByName(docs.limit(3)).unionByName(long).unionByName(one.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10**9 + 1).cast("long"))).unionByName(one.withColumn("text", F.lit(None).cast("string")))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    name, run = stage
    docs = odd_documents(spark)
    out = run(spark, docs, SF)
    if run is corpus_pipeline.STAGES[-1][1]:
        assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    else:
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert run(spark, docs.limit(0), SF).count() == 0


def test_hosts_of_many_labels(spark):
    index = urlfilter.publish(spark, [("b.c/x/", "block"), ("c/", "allow")])
    df = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "b.c/x/y"), (2, "http://" + "." * 100_000 + "c/x/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urlfilter.filter_urls(df, index).collect()} == {1: "b.c/x/", 2: "c/"}


def test_stages_with_names_of_any_case_and_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name in ("Score", "N_Lines", "IDS", "a`b", "a.b", "Round_Trip"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r["Score"] == "Score" and r["N_Lines"] == "N_Lines" and r["a`b"] == "a`b" and r["a.b"] == "a.b" for r in out.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {"a`b", "a.b", "Score", "ids", "round_trip"} <= set(out.columns) and out.count() == 40


def test_near_dedup_keeps_texts_of_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d + " more"), (None, a), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Doc", F.lit(1))
    out = corpus_pipeline.minhash_near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str)[:6] == sorted([(1, a), (2, b), (3, c), (4, ""), (5, None)] + [g for g in got if g[0] is None], key=str)
    assert len(got) == 6 and {t for i, t in got if i is None} <= {d, d + " more"}


def test_rows_to_learn_from_are_bounded(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} of words") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    seen = []
    fit = quality.BoostedTrees.fit
    try:
        quality.BoostedTrees.fit = classmethod(lambda cls, x, y, **k: seen.append(len(x)) or fit(x, y, **k))
        quality.train(docs, labels, "quality", max_rows=10)
    finally:
        quality.BoostedTrees.fit = fit
    assert seen == [10]
