"""Spelling variants of words by rolling-hash deletions.

Words within one edit share a deletion: a replaced code point leaves both words
equal without it, an inserted one leaves the longer word equal to the shorter.
Each word thus gets a key for itself and one for itself without each of its code
points. Keys are polynomial hashes of a prefix and a suffix, taken for a block of
words at once with prefix sums over their code points. Keys are dealt by their
highest bits and sorted; rows whose key no other row has go at once. The others
fetch their strings, are dealt and sorted again, and each run of one key is told
apart by the strings themselves, so equal hashes of different strings count for
nothing. Strings only travel with shared keys, so a word of a million letters
costs a million small rows, not their square.

A run holds words that differ in one place from one string, so at most as many
as the alphabet has letters times the string's length: no group is unbounded. No
pairs are made: of the words alike but for one place each needs their number and
the best two.

Forms are followed by pointer doubling. A form has ``ratio`` times the word's
occurrences at least, so chains are no longer than the logarithm of the largest
count, and the rounds are known beforehand.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty one; repeated rows count each; very long texts are counted in sections cut
between words. Equal counts: the word that is smaller in code-point order. An
empty table gives no words. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import stored
from treeline.llm.shingles import mix

SECTION = 1 << 20
HELD_WORDS = 200_000
RADIX_BITS = 12
_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
KEYS = "key long, pos int, wid long"


def _sections(text: str, between: re.Pattern) -> Iterator[str]:
    """The text in sections of about SECTION code points, cut where ``between`` matches."""
    at = 0
    while at < len(text):
        cut = between.search(text, at + SECTION)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, drop_every: int = 31) -> DataFrame:
    """(word, n): maximal runs of ASCII and Latin-1 letters, A-Z lower-cased, with n occurrences in all texts.

    A run whose crc32 of ``<doc_id>:<run>`` is divisible by ``drop_every`` loses
    the code point at that crc32 modulo its length; 0 leaves all runs as they are.
    """
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")
    between = re.compile("[^A-Za-zÀ-ÿ]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{doc or ''}:".encode())
                for section in _sections(text or "", between):
                    # bytes.lower() changes A-Z alone.
                    for word, n in Counter(letters.findall(section.encode().lower().decode())).items():
                        raw = word.encode()
                        if drop_every and not (h := zlib.crc32(raw, head)) % drop_every:
                            if len(word) == min_chars:
                                continue
                            i = h % len(word)
                            raw = (word[:i] + word[i + 1 :]).encode()
                        held[raw] = held.get(raw, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield from emit()
        yield from emit()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, pos, word's place in the list): pos -1 is the word itself, else the place of the code point left out."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    up, down = np.full(len(flat) + 1, _P), np.full(len(flat) + 2, _P_INV)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat))
    first, last = start[of], (start + size)[of]
    prefix, suffix = sums[at] - sums[first], sums[last] - sums[at + 1]
    cut = mix((prefix + suffix * _P_INV) * down[first] + (size[of] - 1).astype(np.uint64))
    whole = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
    pos = np.concatenate([np.full(len(words), -1), at - first]).astype(np.int32)
    return np.concatenate([whole, cut]).view(np.int64), pos, np.concatenate([np.arange(len(words)), of])


def _make_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        ends, total = [0], 0
        for i, w in enumerate(words):
            total += len(w) + 1
            if total >= SECTION or i == len(words) - 1:
                ends.append(i + 1)
                total = 0
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            key, pos, of = deletion_keys(words[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(ids[a:b][of], pa.int64())], ["key", "pos", "wid"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key comes twice or more."""
    held: pa.RecordBatch | None = None  # the row before, until it is known whether another has its key
    passed = False  # whether that row is to pass already
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[passed and bool(held)], same])
        keep[:-1] |= same
        yield from table.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
        held, passed = table.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
    if held and passed:
        yield held


def _run_results(rows: list[tuple]) -> Iterator[tuple]:
    """(wid, near, best_n, best) from the rows (pos, wid, word, n) of one key."""
    by_string: dict[str, list[tuple]] = {}
    for row in rows:
        pos, _, word, _ = row
        by_string.setdefault(word if pos < 0 else word[:pos] + word[pos + 1 :], []).append(row)
    for alike in by_string.values():
        if len(alike) < 2:
            continue
        whole = next((r for r in alike if r[0] < 0), None)
        if whole:
            longer = {r[1]: r for r in alike if r[0] >= 0}  # a letter of a doubled pair may go at either place
            if longer:
                best = min(longer.values(), key=lambda r: (-r[3], r[2]))
                yield whole[1], len(longer), best[3], best[2]
                for wid in longer:
                    yield wid, 1, whole[3], whole[2]
        places: dict[int, list[tuple]] = {}
        for r in alike:
            if r[0] >= 0:
                places.setdefault(r[0], []).append(r)
        for own in places.values():
            if len(own) > 1:
                own.sort(key=lambda r: (-r[3], r[2]))
                for i, r in enumerate(own):
                    other = own[0 if i else 1]
                    yield r[1], len(own) - 1, other[3], other[2]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (key, pos, wid, word, n) sorted by key."""
    out: list[tuple] = []
    held: list[tuple] = []
    held_key = None

    def emit(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["wid", "near", "best_n", "best"])
            out.clear()

    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != held_key:
                if len(held) > 1:
                    out.extend(_run_results(held))
                    yield from emit(8192)
                held, held_key = [], key
            held.append(tuple(row))
    if len(held) > 1:
        out.extend(_run_results(held))
    yield from emit(1)


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt by the keys' highest bits and sorted by key."""
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")


def variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each word once.

    n_near: words that differ by one code point inserted, deleted or replaced.
    form: of these the one with the largest n, if that is ``ratio`` times the
    word's own or more. root: where following the forms ends.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more, else forms could go round in circles")
    words = stored(counts.select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    shared = _dealt(words.select("word", "wid").mapInArrow(_make_keys, KEYS)).mapInArrow(_shared, KEYS)
    named = shared.join(words, "wid").select("key", "pos", "wid", "word", "n")
    near = _dealt(named).mapInArrow(_verified, "wid long, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))  # strings compare in code-point order
    near = near.groupBy("wid").agg(F.sum("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(near, "wid", "left").select("word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out = stored(out)
    linked = out.where("form is not null")
    most = linked.agg(F.max("form_n"), F.min("n")).first()
    steps = 1 + int(math.log(most[0] / most[1], ratio) + 1e-9) if most[0] else 0  # no chain is longer
    ends = linked.select("word", F.col("form").alias("end"))
    for _ in range(math.ceil(math.log2(steps)) if steps else 0):
        ends = stored(ends)
        beyond = ends.select(F.col("word").alias("end"), F.col("end").alias("beyond"))
        ends = ends.join(beyond, "end", "left").select("word", F.coalesce("beyond", "end").alias("end"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op11_variants": op11_variants}
ORACLE: dict[str, str] = {}
