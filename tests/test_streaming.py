from __future__ import annotations

import datetime

import pytest

from treeline.operators.incremental import debounce
from treeline.streaming import refresh, snapshots, state, timers

T0 = datetime.datetime(2024, 1, 1)


def test_stream_debounce_matches_batch(spark, tmp_path):
    rows = [(p, T0 + datetime.timedelta(milliseconds=ms)) for p, ms in [("a", 0), ("a", 150), ("a", 340), ("a", 900), ("b", 100), ("b", 301)]]
    frame = spark.createDataFrame(rows, "path string, ts timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = refresh.debounced(stream, "path", "ts").writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in debounce(frame, "path", "ts", 200).select("path", "first", "last", "n").collect()}
    assert {tuple(r) for r in spark.table("bursts").select("path", "first", "last", "n").collect()} == want == {("a", rows[0][1], rows[2][1], 3), ("a", rows[3][1], rows[3][1], 1), ("b", rows[4][1], rows[4][1], 1), ("b", rows[5][1], rows[5][1], 1)}


def test_upserts_replace_by_key_and_delete(spark, tmp_path):
    folder = str(tmp_path / "t")
    apply = refresh.upsert_into(folder, "path", buckets=3)
    schema = "path string, v int, deleted boolean"
    apply(spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 5, None)], schema), 0)
    for n in (1, 1, 0):  # a batch that runs again, and a new checkpoint, change nothing
        apply(spark.createDataFrame([("a", 3, False), ("a", 4, None), ("b", 9, True), ("b", 9, True)], schema), n)
        assert sorted(tuple(r) for r in refresh.current(spark, folder).collect()) == [("a", 3), ("a", 4), ("c", 5)]
    apply(spark.createDataFrame([("b", 7, None)], schema), 2)
    assert sorted(tuple(r) for r in refresh.current(spark, folder).collect()) == [("a", 3), ("a", 4), ("b", 7), ("c", 5)]


# -- snapshots -----------------------------------------------------------------
ROWS = "path string, v int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_snapshots_equal_a_dictionary_through_compactions(spark, tmp_path):
    import random

    rng, want, history = random.Random(1), {}, {0: {}}
    table = snapshots.Snapshots(spark, str(tmp_path), "path", ROWS, fanout=2)
    assert rows_of(table.read()) == [] and table.generation() == 0
    for n in range(1, 8):
        puts = {rng.choice("abcdef"): [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(2)}
        gone = {rng.choice("abcdefx") for _ in range(2)}
        frame = spark.createDataFrame([(k, v) for k, own in puts.items() for v in own], ROWS)
        assert table.apply(frame, spark.createDataFrame([(k,) for k in gone], "path string")) == n
        want = {k: v for k, v in want.items() if k not in gone} | puts
        history[n] = want
    flat = lambda d: sorted(((k, v) for k, own in d.items() for v in own), key=str)
    assert all(rows_of(table.read(n)) == flat(d) for n, d in history.items() if n)  # each generation stays readable
    assert len(table._latest()[1]["runs"]) < 4
    with pytest.raises(ValueError):
        table.read(99)
    assert table.expire(keep=2) > 0 and rows_of(table.read()) == flat(want) and rows_of(table.read(6)) == flat(history[6])
    with pytest.raises(ValueError):
        table.read(2)


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    table = snapshots.Snapshots(spark, str(tmp_path), "path", ROWS, fanout=8)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    table.apply(spark.range(200_000).selectExpr("concat('p', hash(id)) as path", "cast(id as int) as v"))
    first = size()
    for n in range(3):
        table.apply(spark.createDataFrame([(f"new{n}", 1)], ROWS))
    assert size() - first < first / 20 and table.read().count() == 200_003


def test_stops_repeats_and_two_writers(spark, tmp_path, monkeypatch):
    table = snapshots.Snapshots(spark, str(tmp_path), "path", ROWS, fanout=2)
    each = table.into("s")
    one = spark.createDataFrame([("a", 1, None), ("b", 2, False), (None, 3, None)], ROWS + ", deleted boolean")
    each(one, 0)
    each(one, 0)  # the batch runs again
    assert table.generation() == 1 and rows_of(table.read()) == [("a", 1), ("b", 2), (None, 3)]
    two = spark.createDataFrame([("a", 1, True), ("b", 5, True), ("b", 6, None), (None, 0, True)], ROWS + ", deleted boolean")
    commit = table._commit
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        each(two, 1)
    monkeypatch.setattr(table, "_commit", commit)
    assert rows_of(table.read()) == [("a", 1), ("b", 2), (None, 3)]
    each(two, 1)
    assert rows_of(table.read()) == [("b", 6)] and rows_of(table.read(1)) == [("a", 1), ("b", 2), (None, 3)]
    with pytest.raises(snapshots.Conflict):
        table._commit(table.versions()[-1], {})
    table.expire()
    assert rows_of(table.read()) == [("b", 6)] and len(list((tmp_path / "runs").iterdir())) == len(table._latest()[1]["runs"])


def test_a_stream_into_snapshots(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, None), ("b", 2, None)], ROWS + ", deleted boolean")
    frame.write.parquet(str(tmp_path / "in"))
    table = snapshots.Snapshots(spark, str(tmp_path / "t"), "path", ROWS)
    for more in ([], [("a", 7, None), ("b", None, True)]):
        if more:
            spark.createDataFrame(more, frame.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.into("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows_of(table.read()) == [("a", 7)] and rows_of(table.read(1)) == [("a", 1), ("b", 2)]


# -- timers --------------------------------------------------------------------
@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def fed(spark, tmp_path, made, schema, waves, seconds):
    """What a stream of waves of rows has given after each; a wave's wait is long enough for the timers."""
    import time

    folder, seen = tmp_path / "in", []
    folder.mkdir()
    name = f"out{abs(hash(str(tmp_path)))}"
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().selectExpr("cast(null as string) as k", "cast(null as long) as seq", "cast(null as string) as v")
    rows = spark.readStream.schema(schema).parquet(str(folder)).union(ticks)  # ticks keep batches coming
    q = made(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for wave, wait in zip(waves, seconds, strict=True):
            if wave:
                spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(str(folder))
            end = time.time() + 60
            while time.time() < end and len(spark.table(name).collect()) < wait:
                time.sleep(0.5)
            seen.append(rows_of(spark.table(name)))
    finally:
        q.stop()
    return seen


def test_values_settle_by_the_wall_clock(rocks, tmp_path):
    schema = "k string, seq long, v string"
    waves = [[("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], [("a", 4, "w")]]
    first, second = fed(rocks, tmp_path, lambda s: timers.settled(s, "k", "seq", "v", 150), schema, waves, [2, 3])
    assert first == [("a", 3, "z"), ("b", 1, None)] and second == sorted([*first, ("a", 4, "w")], key=str)


def test_roots_idle_by_the_wall_clock(rocks, tmp_path):
    import datetime

    schema = "k string, seq long, v string"
    events = [("a", 1, "open"), ("a", 2, "close"), ("b", 3, "open"), ("c", 4, "use")]
    got, later = fed(rocks, tmp_path, lambda s: timers.idle(s, 200, "k", "seq", "v"), schema, [events, [("b", 9, "close")]], [2, 3])
    now = datetime.datetime(2024, 1, 1)
    batch = rocks.createDataFrame([(k, now + datetime.timedelta(milliseconds=n), v) for k, n, v in events], "root string, ts timestamp, kind string")
    roots = {r["root"] for r in state.idle(batch, now + datetime.timedelta(seconds=9), 200).collect()}
    assert got == [("a", 2), ("c", 4)] and {r for r, _ in got} == roots and later == [*got[:1], ("b", 9), *got[1:]]
