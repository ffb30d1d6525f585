"""Incremental refresh: debounced changes, latest state, migration folds, keyed replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(changes: DataFrame, key: str, ts: str, quiet_ms: int) -> DataFrame:
    """(key, first, last, n): runs of changes of a key with less than ``quiet_ms`` between neighbours."""
    order = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    apart = F.coalesce(micros - F.lag(micros).over(order) >= quiet_ms * 1000, F.lit(True))
    runs = changes.withColumn("__run", F.sum(apart.cast("int")).over(order))
    return runs.groupBy(key, "__run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order given; map-side combined, so a hot key costs no more."""
    rest = [c for c in changes.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("row")
    return changes.groupBy(key).agg(last).select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the keys in new replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fold(ddl: DataFrame) -> DataFrame:
    """(table, column, seq): the columns alive after an ordered log (seq, op, table, column) of create, add, drop, drop_table.

    A column's last operation decides; dropping a table ends all its columns
    from before, and adding to an unknown table is ignored.
    """
    by_table = Window.partitionBy("table").orderBy("seq", F.col("op") != "drop_table")
    seen = ddl.withColumn("dropped", F.max(F.when(F.col("op") == "drop_table", F.col("seq"))).over(Window.partitionBy("table")))
    born = F.max(F.when(F.col("op") == "create", F.col("seq"))).over(by_table.rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("born", born).where("op = 'create' or (op in ('add', 'drop') and born is not null)").where("dropped is null or seq > dropped")
    last = seen.groupBy("table", "column").agg(F.max(F.struct("seq", "op")).alias("last"))
    return last.where("column is not null and last.op <> 'drop'").select("table", "column", F.col("last.seq").alias("seq"))


def lookup(sites: DataFrame) -> DataFrame:
    """One row for each place (path, line, col), that of the highest confidence rank."""
    order = Window.partitionBy("path", "line", "col").orderBy(F.col("conf").desc(), "name")
    return sites.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")
