"""Settling and idling by the wall clock: state and timers for each key, kept by Spark.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)
and a stream that keeps triggering, as a timer fires with the batch that runs after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Settling(StatefulProcessor):
    """Holds a key's last value; each new one puts the timer off by the quiet time."""

    def __init__(self, quiet_ms: int):
        self._quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "seq long, value string")
        self._due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:
        held = self._held.get() if self._held.exists() else None
        best = max(((r["seq"], r["value"]) for r in rows), key=lambda x: (x[0], x[1] or ""))
        if held is None or best[0] >= held[0]:
            self._held.update(best)
        if self._due.exists():
            self._handle.deleteTimer(self._due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self._quiet
        self._handle.registerTimer(due)
        self._due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._due.exists() and self._due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            seq, value = self._held.get()
            self._held.clear()
            self._due.clear()
            yield Row(key=key[0], seq=seq, value=value)

    def close(self) -> None:
        pass


def settled(changes: DataFrame, key: str, seq: str, value: str, quiet_ms: int = 150) -> DataFrame:
    """(key, seq, value): a key's last value, by seq, once no batch has brought it another for ``quiet_ms``.

    The wait begins with a key's first change, so what is asked for next is
    waited for, and then for quiet. Values after that begin anew.
    """
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value")).where("seq is not null")
    out = rows.groupBy("key").transformWithState(_Settling(quiet_ms), "key string, seq long, value string", "Append", "ProcessingTime")
    return out.select(F.col("key").alias(key), F.col("seq").alias(seq), F.col("value").alias(value))


class _Idling(StatefulProcessor):
    """Counts who holds a root; the timer runs while nobody does."""

    def __init__(self, timeout_ms: int):
        self._timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._root = handle.getValueState("root", "holders long, last long, due long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:
        holders, last, due = self._root.get() if self._root.exists() else (0, None, None)
        for r in rows:
            holders += {"open": 1, "close": -1}.get(r["kind"], 0)
            last = max(x for x in (last, r["seq"]) if x is not None)
        if due is not None:
            self._handle.deleteTimer(due)
        due = None
        if holders <= 0:
            due = timerValues.getCurrentProcessingTimeInMs() + self._timeout
            self._handle.registerTimer(due)
        self._root.update((holders, last, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._root.exists():
            holders, last, due = self._root.get()
            if holders <= 0 and due == expiredTimerInfo.getExpiryTimeInMs():
                self._root.clear()
                yield Row(root=key[0], last=last)

    def close(self) -> None:
        pass


def idle(events: DataFrame, timeout_ms: int, root: str = "root", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """(root, last) of roots that nobody holds and nobody has used for ``timeout_ms``, from open, close and use; last is their last seq. A root that comes back begins anew."""
    rows = events.select(F.col(root).cast("string").alias("root"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind")).where("seq is not null")
    return rows.groupBy("root").transformWithState(_Idling(timeout_ms), "root string, last long", "Append", "ProcessingTime")
