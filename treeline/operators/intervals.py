"""Points in spans, by buckets of lines: an equi-join whatever the nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a bucket. A span is dealt to each bucket that it touches.
BUCKET = 64


def within(spans: DataFrame, points: DataFrame, key: str, whole: bool = True) -> DataFrame:
    """The pairs of a span (key, low, high, ...) and a point (key, line, ...) in it, both ends included.

    Each point meets the spans of its own bucket only, so it is read once for
    each level of nesting around it, not for each span of its file. With
    ``whole``, a span without ``low`` has all points of its key. A null
    ``high``, or one before ``low``, holds nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("long")
    dealt = F.when(F.col("low") <= F.col("high"), F.sequence(bucket("low"), bucket("high")))
    at = F.array(bucket("line"))
    if whole:
        dealt = F.when(F.col("low").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(dealt)
        at = F.array(F.lit(-1).cast("long"), bucket("line"))
    spans = spans.withColumn("bucket", F.explode(dealt))
    points = points.withColumn("bucket", F.explode(at))
    return spans.join(points, [key, "bucket"]).where("bucket = -1 or (line between low and high)").drop("bucket")


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(path, line, span) of each point (path, line): the smallest span (path, span, lo, hi) around it, the later begun of equal ones; without one, null."""
    near = within(spans.withColumnsRenamed({"lo": "low", "hi": "high"}), points.distinct(), "path", whole=False)
    order = F.struct((F.col("high") - F.col("low")).alias("size"), (-F.col("low")).alias("late"), "span")
    best = near.groupBy("path", "line").agg(F.min(order).alias("best")).select("path", "line", "best.span")
    return points.distinct().join(best, ["path", "line"], "left")
