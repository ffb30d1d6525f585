"""Line dedup over levelled sorted runs of line hashes.

The state is a set of runs in the shared folder. A run is a table of (key, n,
first): line keys, sorted and dealt into buckets, with the number of documents
that hold each and the least of their names. All runs have the same buckets, so
they are merged, and joined with each other, bucket by bucket without a shuffle.
A batch of documents adds its own run at level 0; when a level has ``fanout``
runs they are merged into one run of the next level, so a key is in at most about
fanout * log(batches) runs. Which runs count is said by a manifest that replaces
the one before it in one step: a stop between writing a run and its manifest
leaves the state as it was, and a batch that is named and added again is known.

``dedup_lines`` is the form for a whole table: it goes through the runs in
``batches`` parts by a hash of doc_id, and then the lines whose keys reach
``min_docs`` in all of them go. ``LineRuns.add`` is the incremental form: a batch
loses the lines that reach ``min_docs`` together with what came before; with
``keep_first`` it merge-anti-joins the earlier runs, and of what is new to them
one document keeps the line.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased, as 128 hash bits. Only keys are shuffled to count and to join;
texts move once, to meet the positions of their dropped lines. A key that holds
more than 1/8192 of the frequent keys' documents is joined by broadcast (at most
8192 such keys), so no task gets all places of a very common line.

Defined cases: null and empty texts have one empty line, which is never
dropped. A document counts once for a key that it repeats; documents are
distinct doc_ids, so repeated rows count once, and rows without a doc_id don't
count, but lose frequent lines like others. Keys of fewer than ``min_chars`` code
points are kept. Rows of the same doc_id and text get the same result. Very long
texts and lines are taken whole. With keep_first the least doc_id keeps the line.
An empty table gives no rows. Other columns are kept, whatever their names; those
named ``n_lines``, ``n_dropped`` or ``kept_text`` are replaced by the results.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from treeline.llm.common import named, scratch_root, stored, unlike

_BLANK = " \t\n\x0b\f\r"


def line_keys(min_chars: int):
    """Python rows of (row hash, position, key) for the first position of each key in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, keys, spots = [], [], []
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    spot: dict[bytes, list[int]] = {}
                    for i, line in enumerate(text.split("\n")):
                        line = line.strip(_BLANK)
                        if len(line) >= max(1, min_chars):
                            spot.setdefault(hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest(), []).append(i)
                    rows += [row] * len(spot)
                    keys += spot.keys()
                    spots += spot.values()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(keys, pa.binary()), pa.array(spots, pa.list_(pa.int32()))], ["row", "key", "spots"])

    return run


RESULTS = ("n_lines", "n_dropped", "kept_text")
RUN = "key binary, n long, first string"
HOT_SHARE = 8192


def _rows(docs: DataFrame) -> DataFrame:
    """docs as a struct beside doc_id, text and a name made of both: rows that share it get the same result."""
    kept = unlike(docs.columns, RESULTS)
    name = F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("null")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(17), "text")))
    return docs.select(F.struct(*map(named, kept)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), name.alias("row"))


def _spots(rows: DataFrame, min_chars: int) -> DataFrame:
    found = rows.select("row", "text").mapInArrow(line_keys(min_chars), "row string, key binary, spots array<int>")
    return found.withColumn("doc_id", F.when(~F.col("row").startswith("null"), F.substring("row", 1, 20).cast("long")))


def _strip(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """The rows' own columns with n_lines, n_dropped and the text of the lines that stay as kept_text."""
    gone = drops.groupBy("row").agg(F.flatten(F.collect_list("spots")).alias("gone"))
    joined = rows.select("doc", "text", "row").join(gone, "row", "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                totals, dropped, kept = [], [], []
                for text, out in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    parts = (text or "").split("\n")
                    totals.append(len(parts))
                    away = set(out or ())
                    dropped.append(len(away))
                    if away:
                        text = "\n".join(x for i, x in enumerate(parts) if i not in away)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, batch.schema.field("text").type)], ["doc", *RESULTS])

    schema = StructType([joined.schema["doc"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())])
    out = joined.mapInArrow(run, schema)
    return out.select("doc.*", *RESULTS)


class LineRuns:
    """Levelled sorted runs in ``folder`` (by default a new one in the shared folder); one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = (folder or f"{scratch_root(spark)}/runs-{uuid.uuid4().hex}").rstrip("/")
        self.state = self._read() or {"at": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": []}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _read(self) -> dict | None:
        """The newest whole manifest."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return None
        names = sorted((s.getPath().getName() for s in fs.listStatus(path(self.folder))), reverse=True)
        for name in (n for n in names if n.startswith("manifest-")):
            stream = fs.open(path(f"{self.folder}/{name}"))
            try:
                return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            finally:
                stream.close()
        return None

    def _commit(self, runs: list, batches: list) -> None:
        """The next manifest, complete before it has its name."""
        fs, path = self._fs()
        new = self.state | {"at": self.state["at"] + 1, "runs": runs, "batches": batches}
        draft, final = path(f"{self.folder}/draft-{uuid.uuid4().hex}"), path(f"{self.folder}/manifest-{new['at']:010d}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer changed the runs in {self.folder}")
        self.state = new

    def runs(self) -> list[tuple[int, str]]:
        """(level, path) of the runs that count."""
        return [(level, f"{self.folder}/{name}") for level, name in self.state["runs"]]

    def _table(self, path: str) -> DataFrame:
        """A run as a table that knows its buckets."""
        name = f"line_run_{hashlib.md5(path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, counts: DataFrame) -> str:
        """Writes a run; it doesn't count before a manifest says so."""
        name = f"run-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        n = self.state["buckets"]
        table = f"line_run_{hashlib.md5(path.encode()).hexdigest()}"
        counts.select("key", "n", "first").repartition(n, "key").write.format("parquet").bucketBy(n, "key").sortBy("key").option("path", path).saveAsTable(table)
        return name

    def _merged(self, paths: list[str]) -> DataFrame:
        """(key, n, first) over runs: bucket by bucket, without a shuffle."""
        if not paths:
            return self.spark.createDataFrame([], RUN)
        # The filter takes nothing away; behind it the scans are rows, which a union keeps in their buckets, as it doesn't with column batches.
        both = reduce(lambda a, b: a.union(b), [self._table(p).where("n >= 0") for p in paths])
        return both.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def counts(self) -> DataFrame:
        """(key, n, first) over all runs."""
        return self._merged([p for _, p in self.runs()])

    def append(self, spots: DataFrame, batch: str | None = None, repeats: bool = True, names: bool = True) -> bool:
        """Adds a run of the batch's keys (row, key, doc_id), then merges full levels; False if a batch of that name is in it already.

        repeats: a doc_id may have several rows; names: the least row name is kept.
        """
        if batch is not None and batch in self.state["batches"]:
            return False
        first = F.min("row") if names else F.lit(None).cast("string")
        if repeats:
            spots = spots.groupBy("key", "doc_id").agg(F.min("row").alias("row"))
        counts = spots.groupBy("key").agg(F.count("doc_id").alias("n"), first.alias("first"))
        name = self._write(counts)
        self._commit([*self.state["runs"], [0, name]], [*self.state["batches"], *([batch] if batch is not None else [])])
        self.compact()
        return True

    def compact(self) -> None:
        """Merges full levels. The merged run takes its inputs' place in one step; they are deleted afterwards."""
        while True:
            by_level: dict[int, list[str]] = {}
            for level, name in self.state["runs"]:
                by_level.setdefault(level, []).append(name)
            full = [x for x in sorted(by_level.items()) if len(x[1]) >= self.fanout]
            if not full:
                return
            level, names = full[0]
            merged = self._write(self._merged([f"{self.folder}/{n}" for n in names]))
            self._commit([*(r for r in self.state["runs"] if r[1] not in names), [level + 1, merged]], self.state["batches"])
            self.sweep()

    def sweep(self) -> None:
        """Deletes what no manifest counts: inputs of merges, and what a stop has left."""
        fs, path = self._fs()
        live = {name for _, name in self.state["runs"]}
        for status in fs.listStatus(path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in live:
                self.spark.sql(f"DROP TABLE IF EXISTS line_run_{hashlib.md5(f'{self.folder}/{name}'.encode()).hexdigest()}")
                fs.delete(status.getPath(), True)

    def add(self, docs: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False, batch: str | None = None) -> DataFrame:
        """The batch without lines that reach min_docs with all that came before; its run is added, once.

        keep_first: a line that no earlier batch had stays in one document of
        the batch, the least by its name, so that nothing is lost for good.
        """
        rows = _rows(docs)
        spots = stored(_spots(rows, min_chars))
        fresh = None
        if keep_first and self.state["runs"]:
            own = spots.groupBy("key").agg(F.min("row").alias("first"))
            fresh = stored(own.join(self.counts().select("key"), "key", "left_anti"))
        self.append(spots, batch)
        often = stored(self.counts().where(F.col("n") >= min_docs))
        if fresh is not None:
            often = often.drop("first").join(fresh, "key", "left")
        return _strip(rows, _hits(spots, often, keep_first))


def _hits(spots: DataFrame, often: DataFrame, keep_first: bool) -> DataFrame:
    """(row, spots) of the lines whose keys are in often (key, n, first), but for a key's first row if that keeps it."""
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(often.where(F.col("n") * HOT_SHARE > total).select("key", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))  # at most HOT_SHARE keys
    marked = spots.select("row", "key", "spots").join(hot, "key", "left")
    very = marked.where("hot").select("row", "spots", F.col("hot_first").alias("first"))
    others = marked.where("hot is null").select("row", "key", "spots").join(often.where(F.col("n") * HOT_SHARE <= total).select("key", "first"), "key").select("row", "spots", "first")
    hits = very.unionByName(others)
    return (hits.where("first is null or first <> row") if keep_first else hits).select("row", "spots")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, batches: int = 4) -> DataFrame:
    """All columns of docs, n_lines, n_dropped and kept_text, for one whole table, counted in levelled runs of its parts."""
    rows = _rows(docs)
    spots = stored(_spots(rows, min_chars).withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(23)), F.lit(batches)).cast("int")))
    # Where each doc_id has one row, its keys are distinct already.
    repeats = bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())
    runs = LineRuns(docs.sparkSession, fanout=max(2, batches))
    for part in range(batches):
        runs.append(spots.where(F.col("part") == part), str(part), repeats, keep_first)
    often = stored(runs.counts().where(F.col("n") >= min_docs))
    return _strip(rows, _hits(spots, often, keep_first))


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op6_linededup": op6_linededup}
ORACLE = {
    "op6_linededup": """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, lower_ascii AS key, len(parts) AS n_lines FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i,
      translate(trim(parts[unnest(range(1, len(parts) + 1))], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
),
often AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE o.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.key = o.key
GROUP BY doc_id
"""
}
