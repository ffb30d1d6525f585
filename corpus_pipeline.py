"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents, whatever they are; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontaminate, linededup, minhash, quality, spm
from treeline.llm.common import named, stored
from treeline.llm.toxicity import fold


def _aside(docs: DataFrame, *names: str) -> tuple[dict[str, str], dict[str, str]]:
    """Renames, there and back, for columns of docs that an operator's results would clash with."""
    own = {c: f"own {c}" for c in docs.columns if c.lower() in names}
    return own, {v: k for k, v in own.items()}


def _columns(docs: DataFrame) -> list:
    return [named(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more stay; the classifier learns from labels with crc32(doc_id) mod 4 other than 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2)
    own, back = _aside(docs, "score", "predicted")
    scored = quality.score(docs.withColumnsRenamed(own), model)
    return scored.where("predicted = 1").drop("score", "predicted").withColumnsRenamed(back).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in one of them only, so copies of a clean document don't take it along.

    Documents that lose all their text go: each of their lines is in another document.
    """
    own, back = _aside(docs, "n_lines", "n_dropped", "kept_text")
    clean = linededup.dedup_lines(docs.withColumnsRenamed(own), min_docs=10, min_chars=1, keep_first=True)
    changed = F.col("n_dropped") > 0
    out = clean.where(~changed | (F.length("kept_text") > 0))
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).drop("n_lines", "n_dropped", "kept_text").withColumnsRenamed(back).select(*_columns(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id. Five-word shingles, similarity 0.8.

    Where rows share a doc_id, or have none, they are told apart by numbers of
    their own, so of each group one row stays, whatever its ids.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return _near_dedup_of_rows(docs)
    groups = minhash.near_duplicates(docs, k=5, percent=80)
    gone = stored(groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def _near_dedup_of_rows(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each group of near copies; rows without one come last, and of equal ones one stays."""
    numbered = stored(docs.select(F.struct(*_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("number")))
    rows = numbered.select(F.col("number").alias("doc_id"), F.col("doc.text").alias("text"))
    groups = minhash.near_duplicates(rows, k=5, percent=80).join(numbered.select(F.col("number").alias("doc_id"), F.col("doc.doc_id").alias("own")), "doc_id")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")).alias("first"))
    return numbered.join(stored(first.select(F.col("first.doc_id").alias("number"))), "number", "left_semi").select("doc.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and whether they decode to the text."""
    return spm.encode_checked(docs, spm.load(spm.DEFAULT_MODEL))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Trained trees, MinHash and edit distances can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
