"""Best-fit packing of tokenised documents into sequences, planned on a histogram of lengths.

``pieces`` encodes every document once, ends it with an id, cuts those longer
than a sequence, and writes the pieces with their ids. ``packed`` then needs
their lengths only: how many pieces have each length is at most ``size``
numbers, and best fit, longest first, runs over these counts: all pieces of one
length go to the fullest sequences that still hold one, many sequences of equal
fill at a time. The plan is a list of slots (so many pieces of this length, from
this rank on, to these sequences, at this place). A piece's rank within its
length is the number of such pieces in earlier parts, summed over parts, and its
own count in its part; it finds its slot by that rank. No document is sorted, and
nothing but the histogram reaches the driver.

The plan is broadcast. Its size doesn't depend on the number of documents: a
step either moves a whole group of equal sequences on, or ends a length, which
splits at most two groups off, so there are at most 3 x size groups and size
times as many steps (3 million slots of 48 bytes at 1,024, some thousands as a
rule).

Defined cases: null and empty texts are documents of the end id alone. A null
doc_id stays null. Repeated rows are packed each. Strings that spell a special
token are ordinary text. Very long texts are encoded in sections, cut before
white space that follows something else, where no pre-token spans. An empty
table gives no pieces. Other columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treeline.llm.common import named, stored, unlike

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# The pre-tokenisation pattern of the 50k byte-level vocabulary, and the id that ends a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 2
SIZE = 1024
SECTION = 1 << 20
CACHED = 300_000
#: Texts that are Python strings at a time.
ROWS = 256
PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, nth long"


def _patterns():
    """The pre-tokenisation as ``regex`` has it, and for texts of Latin letters and punctuation in the plainer ``re``, which is some times faster."""
    import regex

    plain = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028)) if not 0x1C <= c <= 0x1F]
    of = lambda kind: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)
    space = "".join(re.escape(c) for c in plain if regex.match(r"\s", c))
    fast = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{of('L')}{of('N')}]").replace(r"\p{L}", f"[{of('L')}]").replace(r"\p{N}", f"[{of('N')}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return regex.compile(PATTERN).findall, re.compile(fast).findall, re.compile(f"[^{''.join(map(re.escape, plain))}]").search, regex.compile(r"(?<=\S)\s").search


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in printable)}


class _Ids(dict):
    """A generation of pre-tokens and their ids as bytes; those that the one before has come from there."""

    def __init__(self, model, letters: dict[int, str], before: dict[str, bytes]):
        super().__init__()
        self._model, self._letters, self._before = model, letters, before

    def __missing__(self, word: str) -> bytes:
        ids = self._before.get(word)
        if ids is None:
            spelt = word.encode().decode("latin-1").translate(self._letters)
            ids = array("I", [t.id for t in self._model.tokenize(spelt)]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Little-endian 32-bit ids of texts by the BPE of a byte-level tokenizer file; pre-tokens are encoded once while two generations remember them.

    A pre-token's ids don't depend on its neighbours, so a text's ids are its
    pre-tokens' ids in order.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_buffer(raw).model
        self._full, self._fast, self._odd, self._cut = _patterns()
        self._letters = _byte_letters()
        self._ids = _Ids(self._model, self._letters, {})

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = self._cut(text, at + SECTION) if len(text) - at > SECTION else None
            end = cut.start() if cut else len(text)
            section = text[at:end] if at or cut else text
            split = self._full if self._odd(section) else self._fast
            out.append(b"".join(map(self._ids.__getitem__, split(section))))
            if len(self._ids) >= CACHED:
                self._ids._before = {}
                self._ids = _Ids(self._model, self._letters, self._ids)
            at = end
        return b"".join(out)


_BUILT: dict[int, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: bytes, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth), written once.

    ids: little-endian unsigned 32-bit; a document's ids and ``end``. Only longer
    ones are cut; then the first piece may be shorter than ``size``. part and nth:
    the task that made a piece, and how many of this length it had made before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    stop = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _BUILT:
            _BUILT[key] = Encoder(shared.value)
        encode, part = _BUILT[key], TaskContext.get().partitionId()
        made = [0] * (size + 1)
        rows: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + stop
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // size)):
                    to = n - size * (-(-n // size) - 1 - k)
                    rows.append((doc, k, at, to - at, ids[4 * at : 4 * to], part, made[to - at]))
                    made[to - at] += 1
                    at = to
                held += len(ids)
                if held >= 1 << 22:
                    yield emit()
                    held = 0
        if rows:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(run, PIECES))


def plan(counts: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank, sequence, per, offset) for counts[length] pieces, by length and rank.

    From rank on, up to the next slot's, pieces of the length go ``per`` to a
    sequence, to sequences from ``sequence`` on, at ``offset`` in each.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by what is left: (first sequence, how many)
    slots, opened = [], 0
    for length in range(size, 0, -1):
        n, rank, left = counts[length], 0, length
        while rank < n:
            while left <= size and not room[left]:
                left += 1
            if left > size:
                left, more = size, -(-(n - rank) // (size // length))
                room[size].append((opened, more))
                opened += more
            sequence, many = room[left].pop()
            per = left // length
            full = min(many, (n - rank) // per)
            if full:
                slots.append((length, rank, sequence, per, size - left))
                room[left - per * length].append((sequence, full))
                rank, sequence, many = rank + full * per, sequence + full, many - full
            if many and rank < n:
                slots.append((length, rank, sequence, n - rank, size - left))
                room[left - (n - rank) * length].append((sequence, 1))
                rank, sequence, many = n, sequence + 1, many - 1
            if many:
                room[left].append((sequence, many))
    return sorted(slots)


def packed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows, which have (length, part, nth) as ``pieces`` makes them, with sequence_id and offset for part and nth.

    rows is read twice and must not change meanwhile; whatever else it holds stays.
    """
    spark = rows.sparkSession
    per_part = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(per_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = [0] * (size + 1)
    for length, n in before.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    table = np.array(plan(counts, size) or [(0, 0, 0, 1, 0)], np.int64)
    shared = spark.sparkContext.broadcast((table[:, 0] << 48 | table[:, 1], table))
    keep = unlike(rows.columns, ("part", "nth", "sequence_id", "offset"))
    schema = StructType([*(rows.schema[c] for c in keep), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slots = shared.value
        for batch in batches:
            *own, length, rank = batch.columns
            length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
            slot = slots[np.searchsorted(first, length << 48 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(slot[:, 2] + nth // slot[:, 3]), pa.array(slot[:, 4] + nth % slot[:, 3] * length)], [*keep, "sequence_id", "offset"])

    ranked = rows.join(before.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select(*map(named, keep), F.col("length").alias("rank length"), (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces: what a trainer reads, at most a sequence's ids in a row."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.aggregate("own", F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x.ids)).alias("ids"))


def load(path: str = DEFAULT_TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op12_packing(spark, sf_dir: str, tokenizer_path: str = DEFAULT_TOKENIZER) -> DataFrame:
    made = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(tokenizer_path))
    return packed(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


QUERIES = {"op12_packing": op12_packing}
ORACLE: dict[str, str] = {}
