"""Centroid clustering by filtering over partition-local ball trees.

Vectors are integers, so every sum is exact. Each task builds metric trees over
the rows it reads; a node stores its range, radius and integer sum. A round
walks the trees with a set of candidate centroids per ball: where the triangle
inequality leaves one, the whole ball goes to it by count and sum; otherwise the
walk descends, at last to exact distances of a leaf's rows. Trees are written
once and read by every round; only centroids, a bounded number, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import tidy

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Rows of a tree and of a leaf.
TREE_ROWS, LEAF = 4096, 32
#: Integer components beyond this could make a squared distance leave 64 bits.
REACH = 1 << 27
NODE = "ids array<{id}>, rows binary, links binary, radius binary, sums binary"
PART = "cluster int, axis int, n bigint, total bigint"


def grid(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, cell) of the vectors that count: ``dimensions`` finite components, each as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    fits = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < REACH / scale))
    return vectors.where(fits).select(F.col(id_col).alias("id"), whole.alias("cell"))


@dataclass
class Tree:
    """Balls over ``rows``: node i covers rows links[i, 0]:links[i, 1]; links[i, 2:] are its halves, -1 in a leaf."""

    rows: np.ndarray
    links: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.links[:, 1] - self.links[:, 0]


def build(rows: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order that a tree puts ``rows`` in, and the tree over them in that order."""
    order, links, radius, sums = np.arange(len(rows)), [], [], []
    todo = [(0, len(rows), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        own = rows[order[begin:end]]
        total = own.sum(0)
        off = own - total / (end - begin)
        apart = (off * off).sum(1)
        node = len(links)
        links.append([begin, end, -1, -1])
        radius.append(np.sqrt(apart.max()) * (1 + 1e-9))
        sums.append(total)
        if parent >= 0:
            links[parent][2 + side] = node
        if end - begin <= LEAF or (own == own[0]).all():
            continue
        # cut across the line from the farthest row to the row farthest from it: halfway if both sides get a share, else evenly
        one = off[apart.argmax()]
        axis = off[((off - one) ** 2).sum(1).argmax()] - one
        along = off @ axis
        near = along < (along.min() + along.max()) / 2
        cut = int(near.sum())
        if min(cut, len(along) - cut) * 8 < len(along):
            cut = len(along) // 2
            split = np.argpartition(along, cut)
        else:
            split = np.argsort(~near, kind="stable")
        order[begin:end] = order[begin:end][split]
        todo += [(begin, begin + cut, node, 0), (begin + cut, end, node, 1)]
    return order, Tree(rows[order], np.array(links, np.int32), np.array(radius), np.array(sums, np.int64).reshape(len(links), -1))


def walk(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their clusters, leaf rows, their clusters): whole balls of one centroid, and rows compared one by one."""
    live, maybe = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    balls, owners, leaves, choices = [], [], [], []
    while len(live):
        middle = tree.sums[live] / tree.counts[live][:, None]
        far = np.sqrt(((middle[:, None, :] - centroids[None]) ** 2).sum(2))
        far[~maybe] = np.inf
        reach = tree.radius[live][:, None]
        least = far.min(1, keepdims=True)
        # a centroid farther from every row of the ball than another is out; the slack covers rounding, so ties stay in
        maybe = maybe & (far - reach <= least + reach + 1e-6 * (1 + least + reach))
        sure = maybe.sum(1) == 1
        balls.append(live[sure])
        owners.append(far[sure].argmin(1))
        leaf = ~sure & (tree.links[live, 2] < 0)
        leaves.append(live[leaf])
        choices.append(maybe[leaf])
        down = ~sure & ~leaf
        live, maybe = tree.links[live[down], 2:].ravel().astype(np.int64), np.repeat(maybe[down], 2, axis=0)
    leaves, choices = np.concatenate(leaves), np.concatenate(choices)
    spans = tree.links[leaves]
    lone = np.concatenate([np.arange(b, e) for b, e in spans[:, :2]]) if len(leaves) else np.zeros(0, np.int64)
    rows = tree.rows[lone].astype(np.int64)
    apart = (rows * rows).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(1)
    apart[~np.repeat(choices, spans[:, 1] - spans[:, 0], axis=0)] = np.iinfo(np.int64).max
    return np.concatenate(balls), np.concatenate(owners), lone, apart.argmin(1)


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Tree]]:
    for ids, rows, links, radius, sums in zip(*batch.columns, strict=True):
        edges = np.frombuffer(links.as_py(), np.int32).reshape(-1, 4)
        totals = np.frombuffer(sums.as_py(), np.int64).reshape(len(edges), -1)
        cells = np.frombuffer(rows.as_py(), np.int32).reshape(-1, totals.shape[1])
        yield ids.values, Tree(cells, edges, np.frombuffer(radius.as_py(), np.float64), totals)


def plant(cells: DataFrame, dimensions: int) -> DataFrame:
    """One row per tree over at most TREE_ROWS rows of a partition."""
    kind = cells.schema["id"].dataType.simpleString()

    def trees(ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        order, tree = build(rows)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (tree.rows.astype(np.int32), tree.links, tree.radius, tree.sums)]
        own = ids.take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(own)], own), *blobs], names=["ids", "rows", "links", "radius", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE_ROWS - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == TREE_ROWS:
                    yield join(held)
                    held, n = [], 0
        if n:
            yield join(held)

    def join(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        cell = table.column(1).combine_chunks()
        return trees(table.column(0).combine_chunks(), cell.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions))

    return cells.mapInArrow(tidy(run), NODE.format(id=kind))


def sums_of(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, axis, n, total): the exact sums of one round."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for _, tree in _trees(batch):
                balls, owners, lone, nearest = walk(tree, centroids)
                np.add.at(n, owners, tree.counts[balls])
                np.add.at(total, owners, tree.sums[balls])
                n += np.bincount(nearest, minlength=k)
                np.add.at(total, nearest, tree.rows[lone].astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, d), pa.int32()), pa.array(np.tile(np.arange(d), len(some)), pa.int32()), pa.array(np.repeat(n[some], d)), pa.array(total[some].ravel())],
            names=["cluster", "axis", "n", "total"],
        )

    parts = trees.mapInArrow(tidy(run), PART)
    return parts.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; a centroid without rows stays."""
    out = centroids.copy()
    for row in sums_of(trees, centroids).collect():
        out[row["cluster"], row["axis"]] = int(row["total"]) // row["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every row."""
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch):
                balls, owners, lone, nearest = walk(tree, centroids)
                cluster = np.zeros(len(tree.rows), np.int32)
                for ball, owner in zip(balls, owners, strict=True):
                    cluster[tree.links[ball, 0] : tree.links[ball, 1]] = owner
                cluster[lone] = nearest
                off = tree.rows.astype(np.int64) - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((off * off).sum(1))], names=["id", "cluster", "distance"])

    return trees.mapInArrow(tidy(run), f"id {kind}, cluster int, distance bigint")


def first_centroids(cells: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The cells of the least hashes of seed and id, in their order; ties by cell. At most ``clusters`` rows travel."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = cells.select(key.alias("key"), "cell").orderBy("key", "cell").limit(clusters).collect()
    return np.array([r["cell"] for r in rows], np.int64)


def _listed(values: list, cluster: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), cluster + 1)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts.

    Vectors that are null, of another length, or hold a null, non-finite or
    absurd component (beyond 2**27 / scale, where squared distances leave 64
    bits) have no row. Equal distances go to the smaller number; repeated rows
    count each, null ids too; fewer vectors than clusters make that many
    centroids; an empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    cells = grid(vectors, id_col, vector_col, dimensions, scale)
    path = scratch.path("trees")
    # small row groups: a reader holds one of them
    plant(cells, dimensions).write.option("parquet.block.size", 16 << 20).parquet(path)
    trees = vectors.sparkSession.read.parquet(path)
    centroids = first_centroids(cells, clusters, seed)
    if not len(centroids):
        out = cells.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return out.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")})
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    rows = scratch.table(assigned(trees, centroids), "assigned")
    inertia = [0] * len(centroids)
    for row in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect():
        inertia[row["cluster"]] = int(row["total"])
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.col("cluster")
    return rows.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        _listed(inertia, own).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        _listed(hashes, own).alias("centroid_sha256"),
    )
