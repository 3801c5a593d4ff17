"""Exact k-means over integer vectors by kd-tree filtering.

Vectors are scaled and floored to integers. Every partition's vectors are laid down once as kd-trees of bounded size,
whose nodes hold counts, integer sums and boxes. In each round a tree is walked a level at a time with the centroids that
may still be nearest: of a box, those that some other centroid strictly dominates (it is nearer to every point of the
box) are pruned; a node with one left is assigned whole by its count and sums; what reaches a leaf is resolved exactly by
squared distances. Rounds read the trees and give back k rows of sums; everything is in integers, so that reruns,
partitionings and lost tasks don't change the result.

Defined results: vectors of another length, null ones, and ones with a null or non-finite component are left out.
Distances tie to the smaller centroid number, equal hashes of ids to the smaller vector. A null id is assigned like any
other, and starts a centroid only where too few others are there. Rows alike each have their row; a centroid without
vectors stays as it was; with fewer vectors than centroids there are as many centroids as vectors; no vectors give an
empty table. A component beyond 2^26 after scaling, whose squared distances a long could not hold, stops the run with an
error. Of the input only the id and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import discard, settle

#: Vectors in one tree, and in one of its leaves.
TREE, LEAF = 4096, 16
#: Integers of this size at most, so that the squared distance of any two vectors of up to 64 components is a long.
LARGEST = 1 << 26
#: Rows by centroids whose differences are made at once.
AT_ONCE = 1 << 12

_TREE_SCHEMA = "ids binary, known binary, points binary, start binary, stop binary, left binary, low binary, high binary, total binary"


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, point): usable vectors as integers floor(scale * x), x as double."""
    x = F.col(vector_column)
    usable = (F.size(x) == dimensions) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    far = F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling"))
    point = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * scale) <= LARGEST, F.floor(v.cast("double") * scale).cast("int")).otherwise(far.cast("int")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), point.alias("point"))


def first_centroids(kept: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "point").orderBy(F.col("h").asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in rows], dtype=np.int64)


def tree_of(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the points, and the nodes over it: each covers start to stop, its children are left and left + 1."""
    order = np.arange(len(points))
    nodes, start, stop, left = [(0, len(points))], [], [], []
    k = 0
    while k < len(nodes):
        a, b = nodes[k]
        own = points[order[a:b]]
        extent = own.max(axis=0) - own.min(axis=0)
        widest = int(extent.argmax())
        if b - a <= LEAF or extent[widest] == 0:
            left.append(-1)
        else:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
            left.append(len(nodes))
            nodes += [(a, a + middle), (a + middle, b)]
        start.append(a)
        stop.append(b)
        k += 1
    own = points[order]
    bounds = [own[a:b] for a, b in nodes]
    return order, {
        "start": np.array(start, dtype=np.int32), "stop": np.array(stop, dtype=np.int32), "left": np.array(left, dtype=np.int32),
        "low": np.array([x.min(axis=0) for x in bounds], dtype=np.int32), "high": np.array([x.max(axis=0) for x in bounds], dtype=np.int32),
        "total": np.array([x.sum(axis=0, dtype=np.int64) for x in bounds]),
    }


def trees(kept: DataFrame, dimensions: int) -> DataFrame:
    """One row a tree, of up to TREE vectors of one partition."""

    def one(ids: list[np.ndarray], known: list[np.ndarray], points: list[np.ndarray]) -> pa.RecordBatch:
        i, n, p = np.concatenate(ids), np.concatenate(known), np.concatenate(points)
        order, nodes = tree_of(p)
        values = {"ids": i[order], "known": n[order], "points": p[order].astype(np.int32), **nodes}
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values.values()], names=list(values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                some = batch.slice(at, TREE)
                ids = some.column(0)
                parts = (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions))
                for whole, part in zip(held, parts, strict=True):
                    whole.append(part)
                size += some.num_rows
                if size >= TREE:
                    yield one(*held)
                    held, size = ([], [], []), 0
        if size:
            yield one(*held)

    return kept.mapInArrow(work, _TREE_SCHEMA)


def nearest(points: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The nearest allowed centroid of each point, of equal ones the first; exact, in integers."""
    out = np.empty(len(points), dtype=np.int64)
    step = max(1, AT_ONCE // len(centroids))
    for a in range(0, len(points), step):
        apart = points[a : a + step, None, :] - centroids[None, :, :]
        distance = np.einsum("nkd,nkd->nk", apart, apart)
        out[a : a + step] = np.where(allowed[a : a + step], distance, np.iinfo(np.int64).max).argmin(axis=1)
    return out


def undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which allowed centroids of each box stay: those that the one nearest to its middle doesn't strictly dominate.

    z is dominated by c if even the point of the box that favours z most, a corner in the direction z - c, is nearer to c.
    """
    out = np.empty_like(allowed)
    step = max(1, AT_ONCE // len(centroids))
    norms = (centroids * centroids).sum(axis=1)
    for a in range(0, len(low), step):
        lo, hi, some = low[a : a + step], high[a : a + step], allowed[a : a + step]
        best = nearest(lo + hi, 2 * centroids, some)
        u = centroids[None, :, :] - centroids[best][:, None, :]
        corner = np.where(u > 0, hi[:, None, :], lo[:, None, :])
        gap = norms[None, :] - norms[best][:, None] - 2 * np.einsum("nkd,nkd->nk", u, corner)
        out[a : a + step] = some & (gap <= 0)
    return out


class Tree:
    """A tree read back from its row."""

    def __init__(self, row: dict[str, bytes], dimensions: int):
        of = lambda name, kind, *shape: np.frombuffer(row[name], dtype=kind).reshape(-1, *shape)
        self.ids, self.known = of("ids", np.int64), of("known", np.bool_)
        self.points = of("points", np.int32, dimensions).astype(np.int64)
        self.start, self.stop, self.left = (of(c, np.int32) for c in ("start", "stop", "left"))
        self.low, self.high = (of(c, np.int32, dimensions).astype(np.int64) for c in ("low", "high"))
        self.total = of("total", np.int64, dimensions)

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """What is settled, level by level: (nodes, centroid of each, None, None) of whole nodes, and (leaves, None, points,
        centroid of each point) of what leaves resolve."""
        # Of equal centroids only the first is ever nearest.
        nodes, allowed = np.zeros(1, dtype=np.int64), np.zeros((1, len(centroids)), dtype=bool)
        allowed[0, np.unique(centroids, axis=0, return_index=True)[1]] = True
        while len(nodes):
            allowed = undominated(self.low[nodes], self.high[nodes], centroids, allowed)
            single = allowed.sum(axis=1) == 1
            yield nodes[single], allowed[single].argmax(axis=1), None, None
            nodes, allowed = nodes[~single], allowed[~single]
            leaf = self.left[nodes] < 0
            ends, of = nodes[leaf], allowed[leaf]
            if len(ends):
                size = self.stop[ends] - self.start[ends]
                points = np.concatenate([np.arange(self.start[e], self.stop[e]) for e in ends])
                yield ends, None, points, nearest(self.points[points], centroids, np.repeat(of, size, axis=0))
            below = self.left[nodes[~leaf]]
            nodes, allowed = np.concatenate([below, below + 1]), np.concatenate([allowed[~leaf]] * 2)

    def sums(self, centroids: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Add this tree's vectors to the counts and sums of their centroids."""
        for nodes, whole, points, each in self.walk(centroids):
            if points is None:
                np.add.at(count, whole, self.stop[nodes] - self.start[nodes])
                np.add.at(total, whole, self.total[nodes])
            else:
                np.add.at(count, each, 1)
                np.add.at(total, each, self.points[points])

    def clusters(self, centroids: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.points), dtype=np.int64)
        for nodes, whole, points, each in self.walk(centroids):
            if points is None:
                for node, c in zip(nodes, whole, strict=True):
                    out[self.start[node] : self.stop[node]] = c
            else:
                out[points] = each
        return out


def moved(planted: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; tasks give k rows of sums, the driver gets k."""
    k, dimensions = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                Tree(row, dimensions).sums(centroids, count, total)
        values = np.concatenate([count[:, None], total], axis=1)
        columns = [pa.array(np.repeat(np.arange(k, dtype=np.int32), dimensions + 1)), pa.array(np.tile(np.arange(dimensions + 1, dtype=np.int32), k)), pa.array(values.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "j", "value"])

    # Place 0 has the count, the others the sums. Sums of all rows may pass a long; they are k rows of so many numbers.
    parts = planted.mapInArrow(work, "cluster int, j int, value long")
    sums = parts.groupBy("cluster", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()
    whole = {(r["cluster"], r["j"]): int(r["s"]) for r in sums}
    out = centroids.copy()
    for c in range(k):
        if n := whole.get((c, 0), 0):
            out[c] = [whole[c, j + 1] // n for j in range(dimensions)]
    return out


def assigned(planted: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row, dimensions)
                own = tree.clusters(centroids)
                apart = tree.points - centroids[own]
                columns = [pa.array(tree.ids, mask=~tree.known), pa.array(own.astype(np.int32)), pa.array((apart * apart).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return planted.mapInArrow(work, "id long, cluster int, distance long")


def k_means(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, prefix: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, written and read back, and the final centroids."""
    if dimensions > 64:
        raise ValueError("squared distances of more than 64 components may pass a long")
    kept = kept_vectors(vectors, id_column, vector_column, dimensions, scale)
    centroids = first_centroids(kept, k, prefix)
    if not len(centroids):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    planted = settle(trees(kept, dimensions))
    for _ in range(rounds):
        before, centroids = centroids, moved(planted, centroids)
        if (before == centroids).all():
            break  # all later rounds would change nothing either
    out = settle(assigned(planted, centroids))
    discard(planted)
    return out, centroids


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _of_cluster(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """One row a vector with its cluster, distance, the inertia of its cluster and of all, and its centroid's digest."""
    found, centroids = k_means(vectors)
    if not len(centroids):
        return found.select(F.col("id").alias("vec_id"), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    each = [sums.get(c, 0) for c in range(len(centroids))]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", _of_cluster(each, "long").alias("cluster_inertia"),
        F.lit(sum(each)).cast("long").alias("inertia"), _of_cluster([digest_of(c) for c in centroids], "string").alias("centroid_sha256"),
    )
