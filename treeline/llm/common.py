"""Shared pieces: scratch tables, grouped streams, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is set, a local one in local mode, as in tests; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/treeline-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def named(name: str) -> Column:
    """The column of exactly this name, whatever it holds (dots, backticks)."""
    return F.col(f"`{name.replace('`', '``')}`")


def unlike(names: list[str], results: tuple[str, ...] | list[str]) -> list[str]:
    """The names that aren't a result's, by Spark's rule that case doesn't count."""
    lowered = {r.lower() for r in results}
    return [n for n in names if n.lower() not in lowered]


def with_results(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], results: str) -> DataFrame:
    """docs and the columns ``results`` (name type, ...), which replace those of the same names; run yields all columns' arrays, docs' own first.

    Within, columns go by their place, as mapInArrow can't take every name.
    """
    new = StructType.fromDDL(results) if results else StructType()
    names = unlike(docs.columns, new.names)
    kept = docs.select(*map(named, names))
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept.schema, *new])])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(it):
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return kept.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(batches, schema).toDF(*names, *new.names)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped(
    df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch] | None], schema: str, order: list[str] | None = None
) -> DataFrame:
    """Applies fn to each run of rows with equal ``key`` (a long), as one Arrow table.

    Rows are dealt by the key and sorted, then streamed: only the group at hand
    is in memory, so callers bound the size of a group first. fn returns record
    batches; small groups cost no pandas or plan overhead.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[a] != held_key:
                    yield from fn(pa.Table.from_batches(held)) or ()
                    held = []
                held_key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held)) or ()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small output batches are put together."""
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in stream(batches):
            kept.append(batch)
            rows += batch.num_rows
            if rows >= 4096 or len(kept) >= 4096:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, rows = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return df.repartition(key).sortWithinPartitions(key, *(order or [])).mapInArrow(merged, schema)


def find(parent: dict, x):
    """Root of x with path halving; a node not seen yet is its own root."""
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = parent[p] = parent.setdefault(p, p)
        x = parent[x]
    return x


def join_roots(parent: dict, a, b) -> bool:
    """Joins two trees under the smaller root; False if they were one."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def block_pairs(n_blocks: Column, block: Column) -> Column:
    """Array of (low, high) structs: all pairs of blocks that hold ``block``; with one block just (0, 0)."""
    others = F.filter(F.sequence(F.lit(0), n_blocks - 1), lambda j: (n_blocks == 1) | (j != block))
    return F.transform(others, lambda j: F.struct(F.least(j, block).alias("lo"), F.greatest(j, block).alias("hi")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node reachable.

    Each round gives the least label among a node's neighbours to the node and to
    the node that its own label names (a tree's root), and then takes the label's
    own label (pointer jumping): whole trees hook on to others, so rounds grow
    with the logarithm of a chain, whatever the order of its numbers. Labels only
    fall, so it ends by itself. They are written to the shared folder each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "component", "near")
        # A node's row has its label before, too; a row for its root has none.
        given = step.select(F.explode(F.array(F.struct("node", F.least("component", "near").alias("to"), F.col("component").alias("old")), F.struct(F.col("component").alias("node"), F.col("near").alias("to"), F.lit(None).cast("long").alias("old")))).alias("x")).select("x.*")
        step = stored(given.groupBy("node").agg(F.min("to").alias("to"), F.max("old").alias("old")))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        new = stored(step.join(hop, "to").select("node", F.least("to", "beyond").alias("component"), (F.least("to", "beyond") < F.col("old")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
