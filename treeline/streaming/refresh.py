"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.workspace import written


def debounced(changes: DataFrame, key: str, ts: str, quiet: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, first, last, n): bursts of changes of a key, each closed by ``quiet`` without one; later than ``late`` is dropped."""
    seen = changes.withWatermark(ts, late)
    runs = seen.groupBy(key, F.session_window(ts, quiet)).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.drop("session_window")


def latest_state(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key so far, in the order given rather than by arrival; for output mode update or complete."""
    rest = [c for c in changes.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("row")
    return changes.groupBy(key).agg(last).select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert_into(folder: str, key: str, buckets: int = 64):
    """A foreachBatch function: rows of the batch's keys in the table replace the old ones; read it with ``current``.

    The table is dealt into buckets by the key, and only those that the batch
    touches are read and written. Replacing by key twice is like once, so a batch
    that runs again, or a new checkpoint over an old table, does no harm. Deleted
    keys leave one row that says so.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        marked = batch.withColumn("deleted", gone).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        # Of a deleted key one row stays, and only if the batch has no live one.
        live = marked.where("not deleted")
        dead = marked.where("deleted").dropDuplicates([key]).join(live.select(key).distinct(), key, "left_anti").select(marked.columns)
        fresh = live.unionByName(dead)
        if _exists(spark, folder):
            touched = [r["bucket"] for r in marked.select("bucket").distinct().collect()]  # at most ``buckets``
            old = spark.read.schema(marked.schema).parquet(folder).where(F.col("bucket").isin(touched))
            fresh = old.join(marked.select(key).distinct(), key, "left_anti").select(marked.columns).unionByName(fresh)
        written(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return apply


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a table that ``upsert_into`` keeps."""
    return spark.read.parquet(folder).where("not deleted").drop("deleted", "bucket")
