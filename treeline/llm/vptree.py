"""Approximate nearest neighbours by vantage-point trees, one per shard.

A vantage-point tree splits its points at the median distance from a vantage
point, down to leaves that are scanned whole. A subtree is skipped if the
triangle inequality, relaxed by ``factor``, says that it can't hold a nearer
point: with ``slack`` the distance between the query and the subtree's shell,
it is skipped if factor * slack > the k-th distance so far. Factor one is the
exact inequality and restores exact search; larger factors skip more. Many
queries descend together, so the work of a node is one numpy call.

Shards are regions of space. A small tree over at most ``sample_rows`` vectors,
those of the smallest hash of vec_id, is built on the driver and sent to the
workers; every row descends it to one region, and regions are cut by a hash into
shards of about ``shard_rows`` rows, so a region of many copies is many shards.
Each shard's own tree is built once, in the task that answers all queries sent
there; queries stream past it in blocks. A query goes first to the shards of its
own region, with the k-th distance in the sample as its bound, and then to those
regions that the same relaxed inequality doesn't rule out by the best of both.
Rows are never copied; a query is copied once for each shard that it visits.
What shards find is cut to k by a ranking that is applied before the shuffle,
too. Nothing but the sample and the regions' sizes goes to the driver.

Defined cases: vectors that are null, empty, all zero, or hold a null, NaN or
infinite component take no part. Only vectors of equal dimension are compared;
dimensions other than the sample's commonest are dealt by hash alone. A row with
a null id takes no part, and a query's candidates are the rows of other ids.
Repeated query rows (same id and vector) are one query. Copies of a vector are
points of their own; ties go to the smaller id. Fewer than k other rows: all of
them. An empty table gives no rows. Other columns are not read, whatever their
names. Vectors may be long: their bytes bound a shard's rows in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import stored

LEAF = 256
_EPS = 1e-9


class VPTree:
    """A vantage-point tree over the rows of ``points``; ids break ties."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.leaf = ids[order], points[order], leaf
        self.scanned = 0
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _build(self, rows: np.ndarray, rng) -> int:
        at = len(self.nodes)
        if len(rows) <= self.leaf:
            self.nodes.append((rows,))
            return at
        self.nodes.append(())
        pick = self.points[rows[rng.integers(len(rows))]]
        dist = distances(self.points[rows], pick[None])[:, 0]
        order = np.argsort(dist, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        shells = dist[near].min(), dist[near].max(), dist[far].min(), dist[far].max()
        self.nodes[at] = (pick, shells, self._build(rows[near], rng), self._build(rows[far], rng))
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of each query's k nearest points other than its own id; infinity and -1 where there are fewer.

        bound: a distance for each query beyond which nothing is wanted. ``scanned`` counts the points compared.
        """
        best = np.full((len(ids), k), np.inf)
        most = np.full(len(ids), np.inf) if bound is None else bound * (1 + _EPS)
        found = np.full((len(ids), k), -1, dtype=np.int64)

        norms = np.einsum("ij,ij->i", queries, queries)

        def scan(rows: np.ndarray, live: np.ndarray) -> None:
            # A product of matrices finds the few that may enter the k nearest; their distances are then taken from differences.
            here = self.points[rows]
            self.scanned += len(rows) * len(live)
            about = norms[live][:, None] + np.einsum("ij,ij->i", here, here) - 2 * (queries[live] @ here.T)
            about[ids[live][:, None] == self.ids[rows][None, :]] = np.inf
            loose = 1e-9 * (norms[live] + np.einsum("ij,ij->i", here, here).max()) + 1e-300
            limit = np.minimum(np.minimum(best[live, -1], most[live]) ** 2, np.partition(about, k - 1, 1)[:, k - 1] if len(rows) >= k else np.inf) + 2 * loose
            who, which = np.nonzero((about <= limit[:, None]) & np.isfinite(about))
            if not len(who):
                return
            diff = queries[live[who]] - here[which]
            dist = np.full(about.shape, np.inf)
            dist[who, which] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            hit = np.unique(who)
            live, dist = live[hit], dist[hit]
            all_d = np.concatenate([best[live], dist], 1)
            all_i = np.concatenate([found[live], np.broadcast_to(self.ids[rows], dist.shape)], 1)
            all_i[np.isinf(all_d)] = -1
            order = np.lexsort((np.where(all_i < 0, np.iinfo(np.int64).max, all_i), all_d), axis=1)[:, :k]
            best[live] = np.take_along_axis(all_d, order, 1)
            found[live] = np.take_along_axis(all_i, order, 1)

        def visit(at: int, live: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                scan(node[0], live)
                return
            pick, (lo1, hi1, lo2, hi2), near, far = node
            dist = distances(queries[live], pick[None])[:, 0]
            slack = {near: np.maximum(np.maximum(lo1 - dist, dist - hi1), 0), far: np.maximum(np.maximum(lo2 - dist, dist - hi2), 0)}
            first = dist < (hi1 + lo2) / 2
            for child, mine in ((near, first), (far, ~first), (far, first), (near, ~first)):
                go = mine & (factor * slack[child] * (1 - _EPS) <= np.minimum(best[live, -1], most[live]))
                if go.any():
                    visit(child, live[go])

        if len(self.ids) and len(ids):
            visit(self.root, np.arange(len(ids)))
        return best, found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of a and b, from differences in double precision."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        np.sqrt(np.einsum("ijk,ijk->ij", diff, diff), out=out[i : i + step])
    return out


class Regions:
    """The small tree over a sample: regions of space, and which of them may hold something near.

    ``splits`` are (vantage point, radius, near child, far child); a child below
    zero is region ``-1 - child``. Near means within the radius, so the bounds
    hold for every row, not for the sample alone.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, regions: int):
        self.ids, self.points, self.splits = ids, points, []
        self.n = 0
        self._build(np.arange(len(ids)), max(1, regions), np.random.default_rng(1))

    def _build(self, rows: np.ndarray, regions: int, rng) -> int:
        if regions > 1 and len(rows) > 1:
            pick = self.points[rows[rng.integers(len(rows))]]
            dist = distances(self.points[rows], pick[None])[:, 0]
            radius = float(np.median(dist))
            near = dist <= radius
            if not near.all():
                at = len(self.splits)
                self.splits.append(())
                half = -(-regions // 2)
                self.splits[at] = (pick, radius, self._build(rows[near], half, rng), self._build(rows[~near], regions - half, rng))
                return at
        self.n += 1
        return -self.n

    def place(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.splits else []
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                pick, radius, near, far = self.splits[at]
                inside = distances(points[rows], pick[None])[:, 0] <= radius
                todo += [(near, rows[inside]), (far, rows[~inside])]
        return out

    def slack(self, points: np.ndarray) -> np.ndarray:
        """(points, regions): a distance that a point of the region has at least."""
        out = np.zeros((len(points), max(1, self.n)))
        todo = [(0, np.zeros(len(points)))] if self.splits else []
        while todo:
            at, least = todo.pop()
            if at < 0:
                out[:, -1 - at] = least
                continue
            pick, radius, near, far = self.splits[at]
            dist = distances(points, pick[None])[:, 0]
            todo += [(near, np.maximum(least, dist - radius)), (far, np.maximum(least, radius - dist))]
        return out

    def bound(self, ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
        """The k-th distance from each point to the sample, without its own id."""
        if len(self.ids) <= k:
            return np.full(len(ids), np.inf)
        out = np.empty(len(ids))
        for a in range(0, len(ids), 64):
            dist = distances(points[a : a + 64], self.points)
            dist[ids[a : a + 64, None] == self.ids[None, :]] = np.inf
            out[a : a + 64] = np.partition(dist, k - 1, 1)[:, k - 1]
        return out


def _points(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return pa.compute.list_flatten(batch.column(at)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _placed(shared, dim: int):
    """Adds region to rows (id, v, dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                region = np.full(part.num_rows, -1, np.int64)
                main = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False) == dim)
                if len(main):
                    region[main] = shared.value.place(_points(part.take(pa.array(main)), 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region)], ["id", "v", "dim", "region"])

    return run


def _routed(shared, dim: int, k: int, factor: float, home: bool):
    """Queries (id, v, dim, bound) with the regions to visit: their own, or all others that may hold something nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                main = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False) == dim)
                other = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False) != dim) if home else main[:0]
                bound = part.column(3).to_numpy(zero_copy_only=False).copy()
                who, where = other, np.full(len(other), -1, np.int64)
                if len(main):
                    mine = part.take(pa.array(main))
                    points = _points(mine, 1)
                    bound[main] = np.minimum(bound[main], regions.bound(mine.column(0).to_numpy(), points, k))
                    own = regions.place(points)
                    if home:
                        q, r = np.arange(len(main)), own
                    else:
                        may = factor * regions.slack(points) * (1 - _EPS) <= bound[main][:, None]
                        may[np.arange(len(main)), own] = False
                        q, r = np.nonzero(may)
                    who, where = np.concatenate([who, main[q]]), np.concatenate([where, r])
                if len(who):
                    out = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(bound[who]), pa.array(where)], ["id", "v", "dim", "bound", "region"])

    return run


def _answered(k: int, factor: float, leaf: int, block: int):
    """Over rows (g, asks, id, v, bound) sorted by g and asks: each shard's tree is built from its rows, then its queries stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column(0).to_numpy(zero_copy_only=False) * 1
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(mark)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if mark[a] != shard:
                    shard, held, tree = mark[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((part.column(2).to_numpy(), _points(part, 3)))
                    continue
                if tree is None and held:
                    tree = VPTree(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), leaf)
                    held = []
                for at in range(0, part.num_rows if tree else 0, block):
                    some = part.slice(at, block)
                    ids = some.column(2).to_numpy()
                    points = _points(some, 3)
                    best, found = tree.search(ids, points, k, factor, some.column(4).to_numpy(zero_copy_only=False))
                    keep = found.ravel() >= 0
                    if keep.any():
                        vectors = pa.array(np.repeat(np.arange(len(ids)), k)[keep])
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[keep]), some.column(3).take(vectors), pa.array(found.ravel()[keep]), pa.array(best.ravel()[keep])], ["id", "v", "vec_id", "score"])

    return run


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, finite throughout, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 16384, block_queries: int = 2048, leaf: int = LEAF, sample_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of vectors for each of queries; both (vec_id, embedding)."""
    context = vectors.sparkSession.sparkContext

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    vectors, queries = clean(vectors), clean(queries).distinct()
    n_rows, longest = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    # Long vectors: at most 2^21 numbers in the sample, 2^22 in a shard.
    sample_rows, shard_rows = min(sample_rows, max(64, 2**21 // longest)), min(shard_rows, max(64, 2**22 // longest))
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).collect()
    dims = [r["dim"] for r in sample]
    dim = max(sorted(set(dims)), key=dims.count, default=0)
    mine = [r for r in sample if r["dim"] == dim]
    regions = Regions(np.array([r["id"] for r in mine], np.int64), np.array([r["v"] for r in mine], np.float64).reshape(len(mine), dim), min(math.ceil(n_rows / shard_rows), max(1, len(mine) // 16)))
    shared = context.broadcast(regions)  # at most sample_rows vectors

    placed = vectors.mapInArrow(_placed(shared, dim), "id long, v array<double>, dim int, region long")
    # At most sample_rows / 16 regions, and one for all other dimensions.
    sizes = vectors.sparkSession.createDataFrame([(r["region"], -(-r["n"] // shard_rows)) for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()], "region long, shards int")
    shard = lambda at: F.xxhash64("dim", "region", at)
    rows = placed.join(F.broadcast(sizes), "region").select(shard(F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")).alias("g"), F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("bound"))

    def visit(asks: DataFrame, home: bool) -> DataFrame:
        routed = asks.mapInArrow(_routed(shared, dim, k, factor, home), "id long, v array<double>, dim int, bound double, region long")
        routed = routed.join(F.broadcast(sizes), "region").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        both = rows.join(routed.select(shard(F.col("at")).alias("g")).distinct(), "g", "left_semi").union(routed.select(shard(F.col("at")).alias("g"), F.lit(True).alias("asks"), "id", "v", "bound"))
        return both.repartition("g").sortWithinPartitions("g", "asks").mapInArrow(_answered(k, factor, leaf, block_queries), "id long, v array<double>, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("id", "v").orderBy("score", "vec_id"))
        return found.withColumn("rank", at).where(F.col("rank") <= k)

    first = stored(ranked(visit(queries.withColumn("bound", F.lit(float("inf"))), True)))
    if regions.n < 2:
        return first.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
    kth = first.groupBy("id", "v").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    asks = queries.join(kth, ["id", "v"], "left").select("id", "v", "dim", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    found = ranked(first.drop("rank").unionByName(visit(asks, False)))
    return found.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


#: On the synthetic vectors of 64 dimensions, measured recall: see tests/llm/test_vptree.py and the README.
PRODUCTION_FACTOR = 1.25


def op2_vptree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"), k=10, factor=PRODUCTION_FACTOR)


QUERIES = {"op2_vptree": op2_vptree}
ORACLE: dict[str, str] = {}
