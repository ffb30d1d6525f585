"""A keyed table of generations, merged when it is read.

A batch replaces all rows of its keys, or deletes them. It is written as a run of
its own, in proportion to itself, with a tombstone for each deleted key; a
manifest then names the runs of the new generation. Nothing that a manifest
names is ever changed, so a reader of a generation sees all of it and nothing
else, whatever is written meanwhile, and a stop before the manifest leaves no
trace but files that ``expire`` removes.

When a level has ``fanout`` runs they are merged into one of the next level, so a
row is written again once a level: a logarithm of the batches. A read takes, of
each key, the rows of its newest run. Keys that only the lowest run has are by
far the most; newer runs' keys are a small table beside it, and only if they
have grown large does Spark shuffle the lowest run for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class Snapshots:
    """The table in a folder; ``key`` is the column whose rows a batch replaces together, ``schema`` the rows' (a DDL string)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout is 2 or more")
        self.spark, self.folder, self.key, self.fanout = spark, folder.rstrip("/"), key, fanout
        self._schema = f"{schema}, __gen long, __gone boolean"
        self._columns = [f.name for f in spark.createDataFrame([], schema).schema]

    # -- manifests -------------------------------------------------------------
    def _fs(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, place: str) -> list[str]:
        fs, path = self._fs(place)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _manifest(self, version: int) -> dict:
        fs, path = self._fs(f"manifests/{version:012d}")
        stream = fs.open(path)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _latest(self) -> tuple[int, dict]:
        versions = self.versions()
        return (versions[-1], self._manifest(versions[-1])) if versions else (0, {"generation": 0, "batches": {}, "runs": []})

    def _commit(self, version: int, manifest: dict) -> None:
        """Writes the manifest beside its place and moves it there, which fails if the place is taken."""
        fs, path = self._fs(f"manifests/{version:012d}")
        _, draft = self._fs(f"manifests/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.folder} is there already")

    # -- writing ---------------------------------------------------------------
    def _run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/runs/{name}")
        return name

    def apply(self, rows: DataFrame, gone: DataFrame | None = None, writer: str = "", batch: int | None = None) -> int:
        """Replaces the rows of the keys in ``rows`` and deletes the keys in ``gone`` that have none; gives the new generation.

        With ``batch``, a number that grows with each batch of a ``writer``, one that was applied before changes nothing.
        """
        version, manifest = self._latest()
        if batch is not None and manifest["batches"].get(writer, -1) >= batch:
            return manifest["generation"]
        generation = manifest["generation"] + 1
        marked = rows.select(*self._columns).withColumns({"__gen": F.lit(generation).cast("long"), "__gone": F.lit(False)})
        if gone is not None:
            dead = gone.select(self.key).distinct().join(rows.select(self.key).distinct(), self.key, "left_anti")
            blank = [F.col(c) if c == self.key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in self._columns]
            marked = marked.unionByName(dead.select(*blank).withColumns({"__gen": F.lit(generation).cast("long"), "__gone": F.lit(True)}))
        batches = manifest["batches"] | ({writer: batch} if batch is not None else {})
        runs = [*manifest["runs"], {"run": self._run(marked), "level": 0}]
        self._commit(version + 1, {"generation": generation, "batches": batches, "runs": runs})
        self.compact()
        return generation

    def into(self, writer: str, deleted: str = "deleted") -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: rows whose ``deleted`` column holds delete their keys, unless the batch has live ones."""

        def each(batch: DataFrame, batch_id: int) -> None:
            gone = F.coalesce(F.col(deleted), F.lit(False))
            self.apply(batch.where(~gone).drop(deleted), batch.where(gone), writer, batch_id)

        return each

    def compact(self) -> None:
        """Merges levels with ``fanout`` runs, oldest level first, until none has; the generation stays."""
        while True:
            version, manifest = self._latest()
            runs = manifest["runs"]
            full = [k for k in {r["level"] for r in runs} if sum(r["level"] == k for r in runs) >= self.fanout]
            if not full:
                return
            level = min(full)
            old = [r["run"] for r in runs if r["level"] == level]
            # Below the lowest run there is nothing for a tombstone to hide.
            lowest = runs[0]["run"] in old
            merged = self._newest(old)
            new = {"run": self._run(merged.where("not __gone") if lowest else merged), "level": level + 1}
            at = next(i for i, r in enumerate(runs) if r["run"] == old[0])
            self._commit(version + 1, manifest | {"runs": [*runs[:at], new, *(r for r in runs[at:] if r["run"] not in old)]})

    # -- reading ---------------------------------------------------------------
    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(*[f"{self.folder}/runs/{r}" for r in runs])

    def _newest(self, runs: list[str]) -> DataFrame:
        """Of each key the rows of its newest generation, tombstones with them; runs come oldest first."""
        if len(runs) == 1:
            return self._read(runs)
        newer = self._read(runs[1:])
        last = newer.groupBy(self.key).agg(F.max("__gen").alias("__last"))
        same = F.col("key").eqNullSafe(F.col(self.key))
        last = last.withColumnRenamed(self.key, "key")
        base = self._read(runs[:1]).join(last, same, "left_anti")
        top = newer.join(last, same & (F.col("__gen") == F.col("__last"))).select(*self._columns, "__gen", "__gone")
        return base.unionByName(top)

    def generation(self) -> int:
        return self._latest()[1]["generation"]

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the last one unless named; a generation that is gone or not there yet is an error."""
        versions = self.versions()
        for v in reversed(versions):
            manifest = self._manifest(v)
            if generation is None or manifest["generation"] == generation:
                break
        else:
            if generation:
                raise ValueError(f"{self.folder} has no generation {generation}")
            manifest = {"runs": []}
        runs = [r["run"] for r in manifest["runs"]]
        if not runs:
            return self.spark.createDataFrame([], self._schema).select(*self._columns)
        return self._newest(runs).where("not __gone").select(*self._columns)

    def expire(self, keep: int = 1) -> int:
        """Drops all but the last ``keep`` generations and every file that none of these has; gives the number of runs removed.

        Run it while nobody writes or reads an older generation.
        """
        versions = self.versions()
        manifests = {v: self._manifest(v) for v in versions}
        wanted = sorted({m["generation"] for m in manifests.values()})[-keep:]
        last = {m["generation"]: v for v, m in manifests.items()}  # a generation's last version has its fewest runs
        stay = {last[g] for g in wanted}
        for name in self._names("manifests"):
            if not name.isdigit() or int(name) not in stay:
                fs, path = self._fs(f"manifests/{name}")
                fs.delete(path, False)
        used = {r["run"] for v in stay for r in manifests[v]["runs"]}
        spare = [n for n in self._names("runs") if n not in used]
        for name in spare:
            fs, path = self._fs(f"runs/{name}")
            fs.delete(path, True)
        return len(spare)
