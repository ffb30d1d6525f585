"""Near-duplicate documents by a MinHash LSH forest.

A document's set is its distinct k-word shingles. Documents of equal sets are
one class, represented by the smallest doc_id. Each class gets ``trees`` sorted
signature orders: in each, classes are sorted by their values of that tree
(range-partitioned, ties dealt by a hash), and those that share the longest
prefixes are neighbours. A region is the run of classes that share ``depth``
values or more.

Candidates of a region: up to ``window`` classes are all compared with each
other. In a larger run each window of the order is, half overlapping the next,
so the depth that neighbours share there is as deep as the crowd makes it: depth
adapts to the region. What deeper prefixes keep apart isn't lost: afterwards, in
regions larger than a window, classes that aren't in one coarse component yet
are compared with each other, in pairs of blocks, however deep their prefixes.

Candidates whose whole signatures agree well enough form coarse components;
inside these true similarities are decided on the full sets, and confirmed links
make the components returned. A coarse component of more than ``block_items``
shingles is dealt twice into random blocks; where that leaves several parts, the
pairs of blocks that could still link two parts are decided as well.

Recall before the exact check: a pair at the threshold 0.8 shares a prefix of 3
in one of 16 orders with probability 1 - (1 - 0.8^3)^16 > 0.99998, in regions of
any size.

Bounds: no task holds more than a window of an order, or two blocks of a region
or a coarse component. A group of near copies costs a number of comparisons
that grows with its size, not its square, once its classes have found each other
in the orders; a crowd of classes that have nothing but a prefix in common costs
the square. Tasks return spanning forests only, never all pairs of a group.
Nothing is collected to the driver.

Defined cases: null, empty and blank texts have an empty set, link with nothing
and keep their own doc_id as component. Fewer than k words: the whole sequence
is the only shingle. Very long texts are worked on whole. Repeated rows are
returned as often as they come; of equal sets the smallest doc_id is kept, in
each of its rows. A null doc_id links with nothing and gets a null component and
kept true. An empty table gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import block_pairs, components, find, grouped, join_roots, stored
from treeline.llm.shingles import mix, shingle_sets

TREES, LEVELS = 16, 8
_MULTIPLIERS = np.random.default_rng(0x5EED_0002).integers(1, 2**62, TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(items: np.ndarray) -> np.ndarray:
    """128 MinHash values of a set, as 16-bit numbers in tree order."""
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(items), 2048):
        part = items[a : a + 2048, None] * _MULTIPLIERS[None, :]
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, part.min(0), out=low)
    return (mix(low) >> np.uint64(48)).astype(">u2")


def set_key(items: np.ndarray) -> bytes:
    """128 bits that two sets share only if equal."""
    return np.array([np.bitwise_xor.reduce(mix(items + np.uint64(0x51))), mix(items).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys, sigs = [], [], []
                for items in shingle_sets(part.column(1).to_pylist(), k):
                    sizes.append(len(items))
                    keys.append(set_key(items) if len(items) else None)
                    sigs.append(signature(items).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _forest(ids: np.ndarray, sigs: np.ndarray, root: np.ndarray, least: int) -> None:
    """Joins, in ``root``, rows whose signatures agree in ``least`` values or more; rows of one root aren't compared."""
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(rest):
            if (root == root[i]).all():
                return
            continue
        near = rest[(sigs[rest] == sigs[i]).sum(1) >= least]
        for r in np.unique(root[near]):
            root[root == r] = root[i]


def _spanning(ids: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of each row's id with the smallest id of its root."""
    order = np.argsort(ids, kind="stable")
    first: dict[int, int] = {}
    pairs = [(first.setdefault(int(root[j]), int(ids[j])), int(ids[j])) for j in order]
    return [p for p in pairs if p[0] != p[1]]


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, TREES * LEVELS)


def _neighbours(least: int, window: int):
    """Over rows (region, rep, sig) in sorted order: spanning forests of candidates among the neighbours of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, ids, sigs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, TREES * LEVELS), np.uint16)
        open_ = False  # whether the rows held were compared with each other already

        def compared(a: int, b: int) -> list[tuple[int, int]]:
            root = np.arange(b - a)
            _forest(ids[a:b], sigs[a:b], root, least)
            return _spanning(ids[a:b], root)

        def close(end: bool) -> list[tuple[int, int]]:
            nonlocal regions, ids, sigs, open_
            cuts = np.concatenate([[0], np.flatnonzero(regions[1:] != regions[:-1]) + 1, [len(regions)]])
            pairs: list[tuple[int, int]] = []
            done = 0
            two = np.flatnonzero(np.diff(cuts[:-1] if not end else cuts) == 2)
            a = cuts[two]
            near = a[(sigs[a] == sigs[a + 1]).sum(1) >= least] if len(a) else a
            pairs += [(min(x, y), max(x, y)) for x, y in zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True) if x != y]
            for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                last = n == len(cuts) - 2
                while b - a > window:
                    pairs += compared(a, a + window)
                    a += window // 2
                    open_ = True
                if last and not end:
                    done = a
                    break
                if b - a > 2 or open_:
                    pairs += compared(a, b)
                open_ = False
                done = b
            regions, ids, sigs = regions[done:], ids[done:], sigs[done:]
            return pairs

        for batch in batches:
            if not batch.num_rows:
                continue
            regions = np.concatenate([regions, batch.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
            sigs = np.concatenate([sigs, _signature_rows(batch.column(2))])
            if pairs := close(False):
                yield _pairs_batch(pairs)
        if len(regions) and (pairs := close(True)):
            yield _pairs_batch(pairs)

    return run


def _across(least: int):
    """Spanning forest of the candidates of a block pair; rows of one coarse component (root) aren't compared."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("rep").to_numpy()
        if len(ids) < 2:
            return
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        before = root.copy()
        _forest(ids, _signature_rows(table.column("sig")), root, least)
        if (before != root).any() and (pairs := _spanning(ids, root)):
            yield _pairs_batch(pairs)

    return run


def _exact(percent: int):
    """Spanning forest of the true links among the sets of a block or a pair; sets of one root are linked already."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("rep").to_numpy()
        if len(ids) < 2:
            return
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        before = root.copy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark = np.zeros(codes.max() + 1, dtype=bool)
        for i in range(len(ids) - 1):
            if (root[i + 1 :] == root[i]).all():
                if (root == root[i]).all():
                    break
                continue
            mine = codes[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            common = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
            mark[mine] = False
            union = sizes[i] + sizes[i + 1 :] - common
            near = np.flatnonzero(100 * common >= percent * union) + i + 1
            for r in np.unique(root[near]):
                root[root == r] = root[i]
        if (before != root).any() and (pairs := _spanning(ids, root)):
            yield _pairs_batch(pairs)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                want = part.column(3).to_pylist()
                keep, items, sizes = [], [], []
                for i, x in enumerate(shingle_sets(part.column(1).to_pylist(), k)):
                    if len(x) and set_key(x) == want[i]:
                        keep.append(i)
                        items.append(x.tobytes())
                        sizes.append(len(x))
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(items, pa.binary()), pa.array(sizes, pa.int64())], ["component", "rep", "items", "size"])

    return run


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _more(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) with further links (a, b) between nodes."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _rooted(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with root, the component that labels give to rep, or rep itself."""
    return df.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def candidates(classes: DataFrame, least: int, depth: int = 3, window: int = 512) -> DataFrame:
    """(node, component): coarse components of those classes (rep, sig) that have a candidate."""
    width = 2 * LEVELS
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("t"), F.substring("sig", t * width + 1, F.lit(2 * depth)).alias("prefix")))
    prefixes = classes.select("rep", F.explode(trees).alias("x")).select("rep", "x.t", F.xxhash64("x.t", "x.prefix").alias("region"))
    crowd = prefixes.groupBy("region").count().where("count > 1").withColumnRenamed("count", "n")
    # Only classes with company go on with their signatures; written once, as the sort samples them first.
    near = stored(prefixes.join(crowd, "region").join(classes.select("rep", "sig"), "rep").select("t", "region", "n", "rep", "sig"))
    value = lambda levels: F.expr(f"substring(sig, t * {width} + 1, {2 * levels})")
    tie = F.xxhash64("rep", F.lit(7))
    crowded = F.col("n") > window
    # The order is cut between regions; only inside those larger than a window it may be cut at any place.
    order = near.repartitionByRange("t", value(depth), F.when(crowded, value(LEVELS)), F.when(crowded, tie)).sortWithinPartitions("t", value(LEVELS), tie)
    labels = components(order.select("region", "rep", "sig").mapInArrow(_neighbours(least, window), "a long, b long"))
    large = _rooted(near.where(crowded).select("region", "rep"), labels)
    apart = large.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("region", "n")
    left = stored(large.join(apart, "region"))
    if not _some(left):
        return labels
    left = left.withColumn("n_blocks", F.ceil(F.col("n") / window).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("n_blocks")).cast("int"))
    dealt = left.join(classes.select("rep", "sig"), "rep").select("rep", "root", "sig", "region", F.explode(block_pairs(F.col("n_blocks"), F.col("block"))).alias("p"))
    dealt = dealt.select("rep", "root", "sig", F.xxhash64("region", "p.lo", "p.hi").alias("g"))
    return _more(labels, grouped(dealt, "g", _across(least), "a long, b long"))


def confirmed(sets: DataFrame, percent: int, block_items: int) -> DataFrame:
    """(node, component) of the true links among sets (component, rep, items, size) of each coarse component."""
    load = sets.groupBy("component").agg(F.sum("size").alias("load")).select("component", F.greatest(F.lit(1), F.ceil(F.col("load") / block_items)).cast("int").alias("n_blocks"))
    dealt = sets.join(load, "component")

    def blocks(df: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("n_blocks"))
        return grouped(df.select("rep", "root", "items", F.xxhash64("component", block).alias("g")), "g", _exact(percent), "a long, b long")

    labels = components(blocks(dealt.withColumn("root", F.col("rep")), 11))
    if not _some(load.where("n_blocks > 1")):
        return labels

    def apart() -> DataFrame:
        """Sets of the coarse components of several blocks that are in several parts."""
        mine = _rooted(dealt.where("n_blocks > 1"), labels)
        parts = mine.groupBy("component").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("component")
        return stored(mine.join(parts, "component", "left_semi"))

    labels = _more(labels, blocks(apart(), 13))
    left = apart()
    if not _some(left):
        return labels
    # A part with a block's load has blocks of its own, whose pairs hold nothing new; the smaller parts share blocks.
    parts = left.groupBy("component", "root").agg(F.sum("size").alias("load"))
    small = F.col("load") < block_items
    rest = parts.where(small).groupBy("component").agg(F.sum("load").alias("rest"))
    parts = parts.join(rest, "component", "left").withColumn("own", F.when(~small, F.col("root"))).withColumn("n", F.ceil(F.when(small, F.col("rest")).otherwise(F.col("load")) / block_items).cast("int"))
    every = parts.select("component", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).distinct().groupBy("component").agg(F.collect_list(F.struct(F.col("own"), F.col("at"))).alias("every"))
    left = left.join(parts.select("component", "root", "own", "n"), ["component", "root"]).withColumn("here", F.struct("own", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("n")).cast("int").alias("at"))).join(every, "component")
    others = F.filter("every", lambda x: x.own.isNull() | F.col("own").isNull() | (x.own != F.col("own")))
    pair = F.transform(others, lambda x: F.array_sort(F.array(F.xxhash64("component", x.own, x["at"]), F.xxhash64("component", "here.own", "here.at"))))
    return _more(labels, grouped(left.select("rep", "root", "items", F.explode(pair).alias("p")).select("rep", "root", "items", F.xxhash64("p").alias("g")), "g", _exact(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, depth: int = 3, window: int = 512, block_items: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Links sets with 100 * intersection >= percent * union. window: classes of a region
    that are compared at once; block_items: shingles in a block of a coarse component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, set_key binary, sig binary"))
    # Equal sets are one class. Its smallest id, and its signature, are the same for each of its rows.
    classes = stored(
        signed.where("set_key is not null and doc_id is not null").groupBy(F.hex("set_key").alias("set_hex")).agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("set_hex", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig"))
    )
    # Signatures of a pair at the threshold differ from it by four standard errors only once in 30,000.
    s = percent / 100
    least = int(TREES * LEVELS * max(0.0, s - 4 * (s * (1 - s) / (TREES * LEVELS)) ** 0.5))
    coarse = candidates(classes.select("rep", "sig"), least, depth, window)
    # Full sets of those classes that have a candidate.
    wanted = coarse.join(classes.select("rep", F.unhex("set_hex").alias("set_key")), F.col("rep") == F.col("node")).select("rep", "component", "set_key")
    texts = docs.join(wanted, docs.doc_id == wanted.rep).select("doc_id", "text", "component", "set_key")
    # A doc_id may stand for several texts; a class is found by its id and its set.
    sets = stored(texts.mapInArrow(_sets(k), "component long, rep long, items binary, size long"))
    linked = confirmed(sets, percent, block_items)
    named = classes.select("set_hex", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("set_hex", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.hex("set_key").alias("set_hex")).join(named, "set_hex", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)


QUERIES = {"op1_minhash": op1_minhash}
ORACLE: dict[str, str] = {}
