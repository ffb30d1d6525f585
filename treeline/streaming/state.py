"""Stateful forms: values that have settled, transitions, sibling generations, memos by generation, idle roots.

Each has a batch form over a table of changes; settling and transitions have a
streaming form with the same rows, kept per key in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(changes: DataFrame, key: str, ts: str, quiet_ms: int) -> DataFrame:
    """The changes that no other change of their key follows within ``quiet_ms``; the last of each key is open and left out.

    A key's changes at one instant count as one, of which the greatest row stands.
    """
    rest = [c for c in changes.columns if c not in (key, ts)]
    one = changes.groupBy(key, ts).agg(F.max(F.struct(*rest)).alias("row")).select(key, ts, "row.*") if rest else changes.distinct()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    after = F.lead(micros).over(Window.partitionBy(key).orderBy(ts))
    return one.withColumn("__gap", after - micros).where(F.col("__gap") >= quiet_ms * 1000).drop("__gap")


def settled_stream(changes: DataFrame, key: str, ts: str, value: str, quiet_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, ts, value) of a stream: a key's last value once event time has passed it by ``quiet_ms``; key and value are strings."""

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        done = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if held:
                done.append((k[0], held[0], held[1]))
            yield pd.DataFrame(done, columns=["key", "ts", "value"])
            return
        rows = sorted((int(t.value // 1000), v) for f in frames for t, v in zip(f[ts], f[value], strict=True))
        for at, v in rows:
            if held and at - held[0] >= quiet_ms * 1000:
                done.append((k[0], held[0], held[1]))
            if not held or at >= held[0]:
                held = (at, v)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(held[0] // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["key", "ts", "value"])

    grouped = changes.withWatermark(ts, late).groupBy(key)
    out = grouped.applyInPandasWithState(step, "key string, ts long, value string", "ts long, value string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("ts").alias(ts), F.col("value").alias(value))


def transitions(states: DataFrame, key: str, ts: str, flag: str, tie: list[str] | None = None) -> DataFrame:
    """(key, ts, entered): where a key's flag changes, in the order of ts; a first flag that is set counts, a first one that isn't doesn't.

    Of one instant, the columns ``tie`` tell the order; without them, unset comes before set.
    """
    before = F.coalesce(F.lag(flag).over(Window.partitionBy(key).orderBy(ts, *(tie or [flag]))), F.lit(False))
    return states.where(F.col(flag).isNotNull()).withColumn("__was", before).where(F.col("__was") != F.col(flag)).select(key, ts, F.col(flag).alias("entered"))


def transitions_stream(states: DataFrame, key: str, ts: str, flag: str) -> DataFrame:
    """(key, ts, entered) of a stream whose rows come in order, batch by batch; the key is a string."""

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        was = state.get[0] if state.exists else False
        out = []
        for at, now in sorted((t, bool(x)) for f in frames for t, x in zip(f[ts], f[flag], strict=True) if x is not None):
            if now != was:
                out.append((k[0], int(at.value // 1000), now))
            was = now
        state.update((was,))
        yield pd.DataFrame(out, columns=["key", "ts", "entered"])

    out = states.groupBy(key).applyInPandasWithState(step, "key string, ts long, entered boolean", "was boolean", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("ts").alias(ts), "entered")


def sibling_rollup(generations: DataFrame, base: DataFrame, key: str = "path", edited: list[str] | None = None) -> DataFrame:
    """Rows (key, gen, ...) of keys that are newer than in ``base`` (key, gen), but for the edited ones; keys that base lacks are new."""
    was = base.select(key, F.col("gen").alias("__was"))
    out = generations.join(was, key, "left").where((F.col("gen") > F.col("__was")) | F.col("__was").isNull()).drop("__was")
    return out.where(~F.col(key).isin(edited)) if edited else out


class Memo:
    """One value for each key, made again when the generation is another; at most ``size`` keys, the longest unused goes first."""

    def __init__(self, size: int = 5000):
        self.size = size
        self._held: dict[object, tuple[object, object]] = {}

    def get(self, key: object, generation: object, make: Callable[[], object]) -> object:
        held = self._held.pop(key, None)
        if held is None or held[0] != generation:
            held = (generation, make())
        self._held[key] = held
        while len(self._held) > self.size:
            del self._held[next(iter(self._held))]
        return held[1]


def idle(events: DataFrame, now, timeout_ms: int) -> DataFrame:
    """(root, last) of roots that nobody holds and nobody used for ``timeout_ms``, from events (root, ts, kind) of open, close and use."""
    held = F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0))
    by_root = events.groupBy("root").agg(held.alias("held"), F.max("ts").alias("last"))
    since = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("last").cast("timestamp"))
    return by_root.where((F.col("held") <= 0) & (since >= timeout_ms)).select("root", "last")
