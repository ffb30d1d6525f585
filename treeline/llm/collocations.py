"""Phrases that are said more often than their parts would be, by bucket-counted passes.

A pass for each length k. While a pass counts its own k-grams exactly, it counts
the (k+1)-grams in buckets of their hashes, so that the next pass needs to count
only those whose bucket is full (PCY, DHP) and whose two k-grams both came out
frequent (Apriori). Both tests are bitmaps of a fixed number of bits, which are
broadcast: 2 MB each at 2^24. They only let too many through, never too few, and
what passes is counted by the words themselves, so results don't depend on hashes
or on the number of buckets; larger corpora want more of them (``bits``), or
prune less. A bucket's count stops at the least number wanted, so a task's
buckets take a byte each, and go out in blocks, sparse or dense, whichever is
smaller; blocks are added up as a stream.

Counts are made a block of text at a time: words become numbers by a dictionary
of the task (cleared when it grows), runs of numbers are counted with numpy, and
each task's sums are added up again before they are shuffled, so a frequent word
is some rows a task, not one an occurrence.

Scores, and which phrases a longer one explains, come from joins of the frequent
phrases with their own parts. A part can be in a third of all phrases; such joins
are left to Spark's splitting of skewed ones.

Defined cases: null and empty texts have no words; a null lang is ``und``, like a
lang of that name; repeated rows count each; pieces without words give nothing; a
word may hold any character that doesn't separate. Very long texts are taken in
sections cut between words, with the words before a cut taken along. An empty
table gives no phrases. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import stored
from treeline.llm.shingles import mix

BITS = 24
BLOCK = 1 << 14
SECTION = 1 << 21
DICTIONARY = 300_000
#: Lower-cased letters; every character that ends a piece is a full stop, a tab is a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
COUNTS = "lang string, phrase string, n long"
BUCKETS = "block int, sparse boolean, data binary"


class Words(dict):
    """Numbers of one language's words; 0 is the end of a piece."""

    def __init__(self, lang: str, all_: list):
        super().__init__({b".": 0})
        self._lang, self._all = lang, all_

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self._all)
        self._all.append((self._lang, word))
        return n


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang))


def longer(gram: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of (k+1)-grams from those of their first k words and of their last word."""
    return mix(gram * np.uint64(0xD6E8FEB86659FD93) + last)


def _bit(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _bucket_rows(buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks that aren't empty: places and counts, or all counts."""
    for first in range(0, len(buckets), BLOCK << 6):
        rows = []
        for at in range(first, min(first + (BLOCK << 6), len(buckets)), BLOCK):
            own = buckets[at : at + BLOCK]
            full = np.flatnonzero(own)
            if len(full):
                sparse = 3 * len(full) < len(own)
                rows.append((at // BLOCK, sparse, full.astype("<u2").tobytes() + own[full].tobytes() if sparse else own.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["block", "sparse", "data"])


def _full_buckets(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of buckets whose counts come to ``least`` or more; 2^bits / 8 bytes reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(BLOCK, np.uint32), -1

        def emit() -> Iterator[pa.RecordBatch]:
            full = total >= least
            if of >= 0 and full.any():
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([np.packbits(full).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, sparse, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != of:
                    yield from emit()
                    total[:], of = 0, block
                if sparse:
                    n = len(data) // 3
                    at = np.frombuffer(data, "<u2", n)
                    total[at] = np.minimum(total[at] + np.frombuffer(data, np.uint8, n, 2 * n), least)
                else:
                    np.minimum(total + np.frombuffer(data, np.uint8), least, out=total)
        yield from emit()

    out = np.zeros(2**bits // 8, np.uint8)
    for block, raw in rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary").collect():
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bytes(raw), np.uint8)
    return out


def _frequent_bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(2**bits, np.uint8)
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes.append([word_hash(lang, w) for w in phrase.encode().split(b" ")])
            if hashes:
                words = np.array(hashes, np.uint64)
                gram = words[:, 0]
                for k in range(1, words.shape[1]):
                    gram = longer(gram, words[:, k])
                buckets[(gram >> np.uint64(64 - bits)).astype(np.int64)] = 1
        yield from _bucket_rows(buckets)

    return _full_buckets(frequent.select("lang", "phrase").mapInArrow(run, BUCKETS), 1, bits)


def _sections(texts: Iterator[bytes], before: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them the section before had too): texts put together up to SECTION bytes, long ones cut between words."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) <= SECTION:
            run.append(text)
            size += len(text)
            if size >= SECTION:
                yield b".".join(run).translate(_TABLE).replace(b".", b" . ").split(), 0
                run, size = [], 0
            continue
        text, at, last = text.translate(_TABLE), 0, []
        while at < len(text):
            cut = min((x for x in (text.find(b" ", at + SECTION), text.find(b".", at + SECTION)) if x >= 0), default=len(text))
            words = last + text[at:cut].replace(b".", b" . ").split()
            yield words, len(last)
            last, at = words[-before:], cut
    if run:
        yield b".".join(run).translate(_TABLE).replace(b".", b" . ").split(), 0


def _pass(docs: DataFrame, k: int, least: int, bits: int, most: int, apriori: np.ndarray | None, bucket: np.ndarray | None) -> DataFrame:
    """Rows of the pass of k-grams, written once: (lang, phrase, n) sums of its sections, and the buckets of (k+1)-grams, if there is a longer pass."""
    shared = docs.sparkSession.sparkContext.broadcast((apriori, bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apriori, bucket = shared.value
        buckets = np.zeros(2**bits if k < most else 0, np.uint8)
        known: list[tuple[str, bytes]] = [("", b".")]
        langs: dict[str, Words] = {}
        hashes, frequent, singles = np.zeros(1, np.uint64), np.zeros(1, bool), np.zeros(1, np.int64)

        def out(rows: list[tuple[str, bytes, int]]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), 1 << 16):
                cols = list(zip(*rows[a : a + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), *[pa.nulls(len(cols[0]), t) for t in (pa.int32(), pa.bool_(), pa.binary())]], ["lang", "phrase", "n", "block", "sparse", "data"])

        def clear() -> Iterator[pa.RecordBatch]:
            nonlocal hashes, frequent, singles
            if k == 1:
                yield from out([(*known[i], int(singles[i])) for i in np.flatnonzero(singles)])
            known[1:], hashes, frequent, singles = [], hashes[:1], frequent[:1], np.zeros(1, np.int64)
            langs.clear()

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for words, again in _sections(iter(texts), k):
                    if lang not in langs:
                        langs[lang] = Words(lang, known)
                    ids = np.fromiter(map(langs[lang].__getitem__, words), np.int64, len(words))
                    if len(known) > len(hashes):
                        fresh = np.fromiter((word_hash(*x) for x in known[len(hashes) :]), np.uint64, len(known) - len(hashes))
                        hashes = np.concatenate([hashes, fresh])
                        if k == 2:
                            frequent = np.concatenate([frequent, _bit(apriori, fresh, bits)])
                    if k == 1:
                        counts = np.bincount(ids[again:], minlength=len(known))
                        counts[: len(singles)] += singles
                        counts[0], singles = 0, counts
                    own = hashes[ids]
                    word = ids > 0
                    # grams: hashes of the n-grams that begin at each place; ok: whether those are to be counted.
                    grams, ok, runs = own, word, word
                    for n in range(2, k + 2):
                        if n > most or len(grams) < 2:
                            ok = ok[:0]
                            break
                        shorter, grams, runs = grams, longer(grams[:-1], own[n - 1 :]), runs[:-1] & word[n - 1 :]
                        if n < k:
                            continue
                        if n == k:
                            both = frequent[ids] if k == 2 else _bit(apriori, shorter, bits)
                            ok = runs & both[:-1] & both[1:]
                            ok[ok] = _bit(bucket, grams[ok], bits)
                            mine = ok.copy()
                            mine[: max(0, again - k + 1)] = False
                            yield from out(_sums(ids, words, known, np.flatnonzero(mine), k))
                        else:
                            wanted = ok[:-1] & ok[1:] & runs
                            wanted[: max(0, again - k)] = False
                            at = (grams[wanted] >> np.uint64(64 - bits)).astype(np.int64)
                            at, seen = np.unique(at, return_counts=True)
                            buckets[at] = np.minimum(buckets[at] + np.minimum(seen, least), least)
                    if len(known) > DICTIONARY:
                        yield from clear()
        yield from clear()
        for rows in _bucket_rows(buckets):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(rows.num_rows, t) for t in (pa.string(), pa.string(), pa.int64())], *rows.columns], ["lang", "phrase", "n", "block", "sparse", "data"])

    return docs.mapInArrow(run, f"{COUNTS}, {BUCKETS}")


def _sums(ids: np.ndarray, words: list[bytes], known: list, at: np.ndarray, k: int) -> list[tuple[str, bytes, int]]:
    """(lang, phrase, n) of the k-grams that begin at the places, told apart by their words' numbers."""
    if not len(at):
        return []
    code = ids[at]
    for j in range(1, k):
        # A number for each distinct beginning, so that it and the next word fit into 64 bits.
        code = (code if j == 1 else np.unique(code, return_inverse=True)[1]) << 32 | ids[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return [(known[ids[i]][0], b" ".join(words[i : i + k]), c) for i, c in zip(at[first].tolist(), n.tolist(), strict=True)]


def frequent_phrases(docs: DataFrame, least: int = 30, most: int = 4, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of phrases of 1 to ``most`` words with f >= least, (lang, n) of all word occurrences), exact."""
    if not 1 <= least <= 255 or not 14 <= bits <= 30:
        raise ValueError("least is 1 to 255, bits 14 to 30")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    found, totals, apriori, bucket = [], None, None, None
    for k in range(1, most + 1):
        rows = stored(_pass(texts, k, least, bits, most, apriori, bucket))
        counts = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = stored(counts.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"))
        found.append(frequent)
        if k < most:
            apriori = _frequent_bitmap(frequent, bits)
            bucket = _full_buckets(rows.where("block is not null").select("block", "sparse", "data"), least, bits)
            if not apriori.any() or not bucket.any():
                break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, totals


def collocations(docs: DataFrame, least: int = 30, most: int = 4, scale: int = 2_000_000, percent: int = 80, top: int = 2000, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words, as the module says.

    score is floor(scale * a / (l + r)) of the cut with the least; phrases that
    lie in a longer frequent one with ``percent`` of their occurrences are left out.
    """
    found, totals = frequent_phrases(docs, least, most, bits)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    # A phrase lies in a longer one that has so much of it only if it lies in one of a word more that does.
    inner = found.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("f").alias("more"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = found.where("k > 1").join(inner, ["lang", "phrase"], "left").where(F.col("more").isNull() | (big("more") * 100 < big("f") * percent))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(part(F.lit(1), i).alias("first"), part(i + 1, F.col("k") - i).alias("rest")))).alias("at", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "at", "cut.first", "cut.rest")
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("best"))
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each of some shares of a language keeps its own first ones, so the last sort has a bounded number of rows.
    share = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = scored.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i : i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)" for k in (1, 2, 3, 4))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, f AS a, {c} AS cut, array_to_string(w[1:{c}], ' ') AS first, array_to_string(w[{c + 1}:], ' ') AS rest FROM cand WHERE k > {c}" for c in (1, 2, 3))
ORACLE = {
    "op13_collocations": rf"""
WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand l ON c.lang = l.lang AND l.k > c.k AND contains(' ' || l.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * l.f::HUGEINT >= 80 * c.f::HUGEINT),
cuts AS ({_CUTS}),
scored AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = first JOIN freq y ON y.lang = c.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
}

QUERIES = {"op13_collocations": op13_collocations}
