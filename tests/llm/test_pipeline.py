"""The pipeline against a plain version on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_minhash import brute
from tests.llm.test_texts import edits

from treeline.llm import quality
from treeline.llm.toxicity import fold

SF = "/root/testdata/sf0.001"


def test_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", fold(F.col("doc_id"), 4) != 2)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {d: t for d, t in sorted(rows.items()) if model.score(quality.features([t]))[0] >= 0.7}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    count = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    first: dict = {}
    lined = {}
    for d, t in rows.items():
        kept = [x for x in t.split("\n") if count[key(x)] < 10 or first.setdefault(key(x), d) == d]
        text = "\n".join(kept)
        if text or text == t:
            lined[d] = text
    stay = {d for d, _, _, kept in brute(list(lined.items()), 5, 80) if kept}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for d in stay:
        text = " ".join(re.findall(r"\w+", lined[d].lower()))
        shared = lambda item: any(item[a : a + 12] in text for a in range(0, len(item) - 11, 4))
        if not any(item in text or shared(item) and edits(item, text) <= int(0.05 * len(item)) for item in items):
            want[d] = lined[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for r in got)


def test_stages_keep_other_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("score", F.lit("s")).withColumn("n_lines", F.lit(1)).withColumn("key", F.lit(2))
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(odd).unionByName(docs.limit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        out.count()
