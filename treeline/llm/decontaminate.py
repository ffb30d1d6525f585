"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised to lower-case words joined by one space. An item
of m characters may be found with up to e = floor(rate * m) edits. Cut into
e + 1 pieces, one piece at least is then free of edits, so an Aho-Corasick
automaton over all pieces finds every candidate; each hit gives a window around
where the item would lie, overlapping windows of an item are merged, and
Myers' bit-parallel algorithm finds the least edit distance of the item to any
part of the window. With e = 0 the item must stand between word boundaries.

Items are taken to the driver in blocks of at most ``block_chars`` characters,
dealt by a hash of their id after their total size is known; each block is one
broadcast and one pass over the documents, so the memory of a worker is bounded
whatever the benchmark's size. A single item over the block size is a block.

Defined cases: null or empty texts match nothing, nor do null or empty items,
nor items of null id. Items of equal text are found each. Repeated rows are
judged each; a null doc_id gives rows of null doc_id. Very long texts are
searched whole. Of matches of equal edits the first to end is given. Empty
tables, of documents or items, give no rows, or the documents as they are. Other
columns, whatever their names, are not read by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import with_results

_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of pattern with a part of text, the first if several; None if over most."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = full, 0, m
    best = (m, 0) if m <= most else None
    get = masks.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            edits += 1
        elif mh & top:
            edits -= 1
        ph = ph << 1 & full  # a match may begin anywhere
        mh = mh << 1 & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if edits <= most and (best is None or edits < best[0]):
            best = (edits, j)
    return best


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.rate = rate
        self.items: list[tuple[int, str, int]] = []
        self.machine = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            budget = int(rate * len(text))
            if not budget:
                text = f" {text} "
            at = len(self.items)
            self.items.append((item_id, text, budget))
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((at, a))
        for piece, owners in pieces.items():
            self.machine.add_word(piece, (len(piece), owners))
        self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, edits, end of the match in the normalised text) of each item found, its best match only."""
        text = normalise(text)
        if not text or not self.items:
            return []
        text = f" {text} "
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.machine.iter(text):
            for at, offset in owners:
                _, item, budget = self.items[at]
                first = end + 1 - size - offset
                spans.setdefault(at, []).append((max(0, first - budget), min(len(text), first + len(item) + budget)))
        out = []
        for at, windows in spans.items():
            item_id, item, budget = self.items[at]
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, exact + len(item)))
                continue
            best = None
            windows.sort()
            low, high = windows[0]
            for a, b in [*windows[1:], (len(text) + 1, 0)]:
                if a <= high:
                    high = max(high, b)
                    continue
                got = myers(item, text[low:high], budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
                low, high = a, b
            if best:
                out.append((item_id, *best))
        return out


_BUILT: dict[tuple, Matcher] = {}


def built(items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a block of items, made once a worker; only the last is kept."""
    key = rate, len(items), hash(tuple(items))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items, rate)
    return _BUILT[key]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", F.lit(23)), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, edits, end): each item found in each document, with its best match."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, end int"
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_chars):
        out = out.union(docs.mapInArrow(_finder(spark.sparkContext.broadcast(items), rate), schema))
    return out


def _finder(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = built(shared.value, rate)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                rows = [(ids[at + i], *hit) for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist()) for hit in matcher.find(text)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "edits", "end"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs in whose texts no item is found, with all their columns."""
    spot = docs.columns.index("text")

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            matcher = built(shared.value, rate)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    fine = [not matcher.find(t) for t in part.column(spot).to_pylist()]
                    yield part.filter(pa.array(fine, pa.bool_())).columns

        return run

    for items in _blocks(benchmark, block_chars):
        docs = with_results(docs, keeper(docs.sparkSession.sparkContext.broadcast(items)), "")
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The pairs (doc_id, item_id) of documents that hold a benchmark item."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
