"""Token counts of documents by separator scan over flat token files.

A flat token file is a run of fixed-width token ids without an index; documents
follow each other, each ended by an end-of-document id. It is read as blocks of
a fixed number of tokens, so a document may straddle blocks. Each block is
scanned with one vectorised comparison for separators; it yields the lengths
of the segments between them, the open segment before its first separator and
the open tail after its last. Blocks are then stitched with a prefix scan: the
tail carried into a block is the sum of the tails and of blocks without any
separator since the last separator, and document numbers are the running count
of separators. Only these few numbers per block are shuffled, never tokens.
The scan runs in two levels (chunks of blocks, then blocks in a chunk), so no
task holds a whole file's blocks.

``flat_blocks`` makes such blocks from texts in memory as the tokenizer emits
them, one flat file a partition; ``file_blocks`` reads files of any size in a
folder, in byte ranges.

Defined cases: a document of no tokens counts 0. Null texts are documents of no
tokens, counted 0. Text that spells the separator is ordinary text and never
makes a separator. Tokens after a file's last separator are a last document
without one, ``closed`` false. An empty file has no documents. A width that
doesn't divide a file's length is an error. Repeated rows are counted each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import stored

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenisation pattern of the 50k byte-level vocabulary, and its free id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_TOKENS = 65536
RANKS_LIMIT = 64 << 20
BLOCK_SCHEMA = "file string, block long, tokens binary, ids array<long>"

_BUILT: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tiktoken encoding of a rank file's bytes, made once a worker."""
    import tiktoken

    if (key := hash(ranks)) not in _BUILT:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _BUILT[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _BUILT[key]


def load_ranks(path: str = DEFAULT_RANKS) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(RANKS_LIMIT + 1)
    if len(raw) > RANKS_LIMIT:
        raise ValueError(f"{path} is larger than {RANKS_LIMIT} bytes")
    return raw


def flat_blocks(docs: DataFrame, ranks: bytes, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, tokens, ids) of the documents' tokens; ids names the documents whose separators lie in the block."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        name = f"part-{TaskContext.get().partitionId():06d}"
        held: list[np.ndarray] = []
        held_n = block = 0
        ends: list[tuple[int, int | None]] = []  # (place of the separator from the file's start, document)
        total = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, held_n, block, ends
            flat = np.concatenate([*held, np.empty(0, np.uint32)]).astype(np.uint32, copy=False)
            at = 0
            while held_n - at >= block_tokens or (last and held_n > at):
                part = flat[at : at + block_tokens]
                at += len(part)
                stop = (block + 1) * block_tokens
                mine = [d for p, d in ends if p < stop]
                ends = ends[len(mine) :]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], ["file", "block", "tokens", "ids"])
                block += 1
            held, held_n = [flat[at:]], held_n - at

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text) if text else [], np.uint32)
                held += [ids, np.array([eod], np.uint32)]
                held_n += len(ids) + 1
                total += len(ids) + 1
                ends.append((total - 1, doc))
                if held_n >= 4 * block_tokens:
                    yield from emit(False)
        yield from emit(True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def file_blocks(spark: SparkSession, path: str, width: int = 4, block_tokens: int = BLOCK_TOKENS, range_blocks: int = 256) -> DataFrame:
    """Blocks of the flat token files of a folder (little-endian ids of 2 or 4 bytes), of any size.

    Each file is dealt out as byte ranges of ``range_blocks`` blocks, which tasks
    read by themselves. That needs a path that pyarrow's file systems open (file,
    hdfs, s3, gs, abfs ...); others are refused.
    """
    if width not in (2, 4):
        raise ValueError("width is 2 or 4")
    step = range_blocks * block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))))
    ranges = ranges.repartition(F.xxhash64("path", "start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes aren't tokens of {width}")
                system, place = FileSystem.from_uri(re.sub("^(\\w+):/(?!/)", r"\1:///", name))
                with system.open_input_file(place) as f:
                    f.seek(start)
                    for at in range(start, min(start + step, length), block_tokens * width):
                        raw = f.read(min(block_tokens * width, length - at))
                        part = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // (block_tokens * width)], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([None], pa.list_(pa.int64()))], ["file", "block", "tokens", "ids"])

    return ranges.mapInArrow(run, BLOCK_SCHEMA)


def _scan(eod: int):
    """Per block: separators, tokens before the first, tokens after the last, and the lengths between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seps, heads, tails, inner = [], [], [], []
            for raw in batch.column(2).to_pylist():
                tokens = np.frombuffer(raw, np.uint32)
                at = np.flatnonzero(tokens == eod)
                seps.append(len(at))
                heads.append(int(at[0]) if len(at) else len(tokens))
                tails.append(len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens))
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(seps, pa.int64()), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "ids", "seps", "head", "tail", "inner"])

    return run


def counts(blocks: DataFrame, eod: int = EOD, chunk: int = 256) -> DataFrame:
    """(file, document, doc_id, n_tokens, closed) of every document in the blocks; document counts from 0 in its file."""
    # Read three times below: stored, so that the tokens behind it are made and scanned once.
    seen = stored(blocks.mapInArrow(_scan(eod), "file string, block long, ids array<long>, seps long, head long, tail long, inner array<long>"))
    seen = seen.withColumn("chunk", F.floor(F.col("block") / chunk))
    here = Window.partitionBy("file", "chunk").orderBy("block")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    # First level: within a chunk. run: number of the run of blocks that share an open document.
    seen = seen.withColumn("n_before", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum((F.col("seps") > 0).cast("long")).over(before), F.lit(0)))
    in_run = Window.partitionBy("file", "chunk", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("seps") > 0, F.col("tail")), ignorenulls=True).over(before)
    seen = seen.withColumn("carry", F.coalesce(F.sum("tail").over(in_run), F.lit(0)) + F.coalesce(last_tail, F.lit(0)))
    # Second level: one row a chunk with its separators and open tail.
    order = F.struct("block", "seps", "tail", "carry")
    ends = seen.groupBy("file", "chunk").agg(F.sum("seps").alias("c_seps"), F.max(order).alias("end"))
    ends = ends.select("file", "chunk", "c_seps", F.when(F.col("end.seps") > 0, F.col("end.tail")).otherwise(F.col("end.tail") + F.col("end.carry")).alias("c_tail"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("c_before", F.coalesce(F.sum("c_seps").over(over), F.lit(0))).withColumn("c_run", F.coalesce(F.sum((F.col("c_seps") > 0).cast("long")).over(over), F.lit(0)))
    c_run = Window.partitionBy("file", "c_run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c_last = F.last(F.when(F.col("c_seps") > 0, F.col("c_tail")), ignorenulls=True).over(over)
    ends = ends.withColumn("c_carry", F.coalesce(F.sum("c_tail").over(c_run), F.lit(0)) + F.coalesce(c_last, F.lit(0)))
    ends = ends.withColumn("last_chunk", F.max("chunk").over(Window.partitionBy("file")))
    both = seen.join(ends, ["file", "chunk"]).withColumn("open", F.col("carry") + F.when(F.col("run") == 0, F.col("c_carry")).otherwise(0)).withColumn("first", F.col("c_before") + F.col("n_before"))
    closed = F.when(F.col("seps") > 0, F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))).otherwise(F.expr("array()").cast("array<bigint>"))
    docs = both.select("file", "first", "ids", F.posexplode(closed).alias("at", "n_tokens"))
    docs = docs.select("file", (F.col("first") + F.col("at")).alias("document"), F.expr("ids[at]").alias("doc_id"), "n_tokens", F.lit(True).alias("closed"))
    tail = ends.where("chunk = last_chunk").select("file", (F.col("c_before") + F.col("c_seps")).alias("document"), F.lit(None).cast("long").alias("doc_id"), F.when(F.col("c_seps") > 0, F.col("c_tail")).otherwise(F.col("c_tail") + F.col("c_carry")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.union(tail.where("n_tokens > 0"))


def token_counts(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs."""
    return counts(flat_blocks(docs, ranks)).select("doc_id", "n_tokens")


def op8_tokencounts(spark, sf_dir: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), load_ranks(ranks_path))


QUERIES = {"op8_tokencounts": op8_tokencounts}
ORACLE: dict[str, str] = {}
