"""Context lines beside a hit, as many as fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a hit with its context.
HIT = 500


def budgeted(before: Column, hit: Column, after: Column, budget: int = HIT) -> tuple[Column, Column]:
    """The context lines that fit beside a hit in ``budget`` bytes: the nearest first, after and before in turn."""
    n = F.greatest(F.size(before), F.size(after))
    none = F.expr("cast(array() as array<struct<side:int,at:int,text:string>>)")
    turns = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.struct(F.lit(1).alias("side"), i.cast("int").alias("at"), F.get(after, i).alias("text")), F.struct(F.lit(0).alias("side"), i.cast("int").alias("at"), F.get(before, F.size(before) - 1 - i).alias("text")))))
    turns = F.filter(F.when(n > 0, turns).otherwise(none), lambda t: t.text.isNotNull())
    start = F.struct((F.lit(budget) - F.octet_length(hit)).cast("int").alias("left"), none.alias("kept"))

    def take(state: Column, t: Column) -> Column:
        cost = F.octet_length(t.text) + 1
        fits = state["left"] >= cost
        return F.struct(F.when(fits, state["left"] - cost).otherwise(-1).cast("int").alias("left"), F.when(fits, F.concat(state["kept"], F.array(t))).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(turns, start, take)["kept"]
    own = lambda side: F.filter(kept, lambda t: t.side == side)
    return F.transform(F.reverse(own(0)), lambda t: t.text), F.transform(own(1), lambda t: t.text)
