"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto their principal directions. The leading
coordinates, cut into cells of width epsilon, order all vectors; runs of that
order are blocks with a bounding box. Pairs of intervals are joined recursively,
first over a tree of blocks, then inside a pair of blocks; intervals whose boxes
are further apart than epsilon are skipped, which loses nothing, as a projection
never lengthens a distance. Leaves compare all their pairs in double precision,
on the vectors as they came: the turned coordinates only order and prune. Pairs
within rounding of the threshold are decided by the plain formula.

Equal vectors are one node. A leaf hands on link counts and a spanning forest
of its links, never the pairs, so dense groups cost no more rows than vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import treesum
from .components import by_root, connected_components
from .scratch import Scratch

THRESHOLD = 0.9
LEADING = 8
BLOCK = 4096
LEAF = 512
FAN = 8
#: Blocks that one task compares with its own; the block goes to as many tasks as it needs.
PARTNERS = 8
#: Pairs this near the threshold are computed again, component by component.
MARGIN = 1e-9


def _scaled(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors in doubles, each times a power of two, which is exact, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Plain formula in double precision, summed in order."""
    dot, xx, yy = (float(np.add.accumulate(v)[-1]) for v in (x * y, x * x, y * y))
    return dot / float(np.sqrt(xx) * np.sqrt(yy))


def _directions(nodes: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal basis, leading directions first, of the second moments of all nodes."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_scaled(batch.column(0), dim))
            total += x.T @ x
        yield treesum.payload(total.ravel())

    total = treesum.tree_sum(nodes.select("embedding").mapInArrow(moments, treesum.SCHEMA), dim * dim)
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


@dataclass
class Vectors:
    """A run of vectors: as they came but for a power of two, of unit length, and their leading turned coordinates."""

    scaled: np.ndarray
    lead: np.ndarray
    unit: np.ndarray = field(init=False)

    def __post_init__(self):
        self.unit = _unit(self.scaled)


def _box_gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Least distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(np.sqrt((gap * gap).sum()))


def join_intervals(x: Vectors, y: Vectors, same: bool, threshold: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Leaves (rows, columns, matrix of links) of two sequences in grid order; ``same`` takes each pair once."""
    # a margin keeps rounding from skipping a pair at the threshold itself
    eps = np.sqrt(max(2 - 2 * threshold, 0.0)) + MARGIN
    stack = [(0, len(x.unit), 0, len(y.unit))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d:
            continue
        if same and d <= a:
            continue
        u, v = x.lead[a:b], y.lead[c:d]
        if _box_gap(u.min(0), u.max(0), v.min(0), v.max(0)) > eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            near = x.unit[a:b] @ y.unit[c:d].T
            links = near >= threshold
            for i, j in np.argwhere(np.abs(near - threshold) < MARGIN).tolist():
                links[i, j] = cosine(x.scaled[a + i], y.scaled[c + j]) >= threshold
            if same:
                links &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            if links.any():
                yield slice(a, b), slice(c, d), links
            continue
        if b - a >= d - c:
            m = a + -(-(b - a) // (2 * LEAF)) * LEAF
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = c + -(-(d - c) // (2 * LEAF)) * LEAF
            stack += [(a, b, c, m), (a, b, m, d)]


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, node) edges that join what a bipartite link matrix joins; columns count on from the rows."""
    n, m = links.shape
    rows, cols = np.arange(n), np.full(m, n + m)
    while True:
        new = np.minimum(cols, np.where(links, rows[:, None], n + m).min(axis=0))
        back = np.minimum(rows, np.where(links, new[None, :], n + m).min(axis=1))
        if (new == cols).all() and (back == rows).all():
            break
        rows, cols = back, new
    label = np.concatenate((rows, cols))
    node = np.flatnonzero((label != np.arange(n + m)) & (label < n + m))
    return node, label[node]


def _blocks(nodes: DataFrame, basis: np.ndarray, eps: float, scratch: Scratch) -> DataFrame:
    """(seq, lo, hi, ids, copies, vectors, lead) in grid order, at most BLOCK vectors each."""
    dim = len(basis)
    lead = min(LEADING, dim)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _scaled(batch.column(2), dim)
            y = _unit(x) @ basis[:, :lead]
            cell = np.floor(y / eps).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, cell.size + 1, lead, dtype=np.int32), cell.ravel())
            rows = [pa.array([v.tobytes() for v in part], pa.binary()) for part in (x, np.ascontiguousarray(y))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *rows], names=["id", "copies", "cell", "vector", "lead"])

    turned = nodes.select("id", "copies", "embedding").mapInArrow(cells, "id bigint, copies bigint, cell array<int>, vector binary, lead binary")
    parts = max(1, min(nodes.count() // BLOCK + 1, 10_000))
    ordered = turned.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0

        def block(rows: list) -> pa.RecordBatch:
            ids, copies = (np.array([r[j] for r in rows], np.int64) for j in (0, 1))
            raw = b"".join(r[3] for r in rows)
            y = np.frombuffer(raw, np.float64).reshape(-1, lead)
            cols = [pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([y.min(0).tolist()], pa.list_(pa.float64())), pa.array([y.max(0).tolist()], pa.list_(pa.float64()))]
            cols += [pa.array([v], pa.binary()) for v in (ids.tobytes(), copies.tobytes(), b"".join(r[2] for r in rows), raw)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "k", "lo", "hi", "ids", "copies", "vectors", "lead"])

        held: list = []
        for batch in batches:
            held += zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4)))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, k = held[BLOCK:], k + 1
        if held:
            yield block(held)

    packed = scratch.table(ordered.mapInArrow(pack, "part bigint, k bigint, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary, lead binary"), "blocks")
    stride = (packed.agg(F.max("k")).first()[0] or 0) + 1
    return packed.withColumn("seq", F.col("part") * stride + F.col("k"))


def _near_blocks(blocks: DataFrame, lead: int, eps: float) -> DataFrame:
    """(a, b) with a <= b of blocks whose boxes are within eps, by descent through a tree over the sequence."""
    level = blocks.select(F.col("seq").alias("node"), *[F.col("lo")[k].alias(f"lo{k}") for k in range(lead)], *[F.col("hi")[k].alias(f"hi{k}") for k in range(lead)])
    levels = [level]
    top = blocks.agg(F.max("seq")).first()[0] or 0
    while top > 0:
        top //= FAN
        boxes = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(lead)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(lead)]
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*boxes))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in reversed(levels[:-1]):
        nodes = nodes.withColumn("up", F.floor(F.col("node") / FAN))
        one = nodes.select(F.col("up").alias("a"), F.col("node").alias("na"), *[F.col(f"{s}{k}").alias(f"a_{s}{k}") for s in ("lo", "hi") for k in range(lead)])
        two = nodes.select(F.col("up").alias("b"), F.col("node").alias("nb"), *[F.col(f"{s}{k}").alias(f"b_{s}{k}") for s in ("lo", "hi") for k in range(lead)])
        gap = F.lit(0.0)
        for k in range(lead):
            g = F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"))
            gap = gap + g * g
        pairs = pairs.join(one, "a").join(two, "b").where((F.col("na") <= F.col("nb")) & (gap <= eps * eps)).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs


def _links(blocks: DataFrame, pairs: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(edge, a, b): edges of the forest where edge is true, else node a and its links b found in one pair of blocks.

    Of two near blocks now the one, now the other is the target, by the parity
    of their sum, so a dense corpus deals every block about as many partners. A
    target meets at most PARTNERS of them in a task, which holds it and streams
    them: two blocks are in memory, and none is in more tasks than it has to be.
    """
    lead = min(LEADING, dim)
    columns = ["ids", "copies", "vectors", "lead"]
    first = (F.col("a") + F.col("b")) % 2 == 1
    dealt = pairs.where("a < b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    # partners of one parity follow each other two by two; those of the other side of the target as well
    dealt = dealt.withColumn("share", F.floor(F.col("other") / (2 * PARTNERS)))
    held = dealt.select("target", "share").distinct().withColumn("other", F.lit(-1).cast("bigint"))
    alone = blocks.select(F.col("seq").alias("target"), F.lit(-1).cast("bigint").alias("share"), F.lit(-1).cast("bigint").alias("other"))
    own = held.select("target", "share", "other").union(alone).join(blocks.withColumnRenamed("seq", "target"), "target")
    others = dealt.join(blocks.withColumnRenamed("seq", "other"), "other")
    named = ["target", "share", "other", *columns]
    rows = own.select(named).union(others.select(named)).repartition("target", "share").sortWithinPartitions("target", "share", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            for row in range(batch.num_rows):
                share, other = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                ids, copies = (np.frombuffer(batch.column(k)[row].as_buffer(), np.int64) for k in (3, 4))
                x, y = (np.frombuffer(batch.column(k)[row].as_buffer(), np.float64).reshape(-1, n) for k, n in ((5, dim), (6, lead)))
                block = ids.copy(), copies.copy(), Vectors(x.copy(), y.copy())
                if other < 0:
                    held = block
                # a block meets itself once, in the share of its own
                if other >= 0 or share < 0:
                    yield _leaf_rows(*held, *block, other < 0, threshold)

    return rows.mapInArrow(run, "edge boolean, a bigint, b bigint")


def _leaf_rows(ids_a: np.ndarray, n_a: np.ndarray, x: Vectors, ids_b: np.ndarray, n_b: np.ndarray, y: Vectors, same: bool, threshold: float) -> pa.RecordBatch:
    """Forest edges and link counts of one pair of blocks."""
    count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    edges = [np.zeros((0, 2), np.int64)]
    for r, c, links in join_intervals(x, y, same, threshold):
        count_a[r] += links @ n_b[c]
        count_b[c] += links.T @ n_a[r]
        u, v = _forest(links)
        names = np.concatenate((ids_a[r], ids_b[c]))
        edges.append(np.stack((names[u], names[v]), 1))
    edge = np.unique(np.concatenate(edges), axis=0)
    i, j = np.flatnonzero(count_a), np.flatnonzero(count_b)
    first = np.concatenate((edge[:, 0], ids_a[i], ids_b[j]))
    second = np.concatenate((edge[:, 1], count_a[i], count_b[j]))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(first)) < len(edge)), pa.array(first), pa.array(second)], names=["edge", "a", "b"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    ``n_links`` counts other vectors at cosine ``threshold`` or more, equal
    ones included; ``component_id`` is the least id reachable by links. Vectors
    that are null, zero or hold null or non-finite components have no link and
    are their own component, as are those with a null id. Vectors of unequal
    length never link. Repeated rows are linked copies. An empty table gives an
    empty result; other columns are not read. Unequal vectors of one id count
    as one vector that has the links of all.
    """
    scratch = Scratch(vectors.sparkSession)
    value = F.col("embedding")
    fine = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(fine & F.col("id").isNotNull(), F.transform(value, lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding")).withColumn("dim", F.coalesce(F.size("embedding"), F.lit(-1)))
    nodes = scratch.table(
        rows.where("embedding is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim")), "nodes"
    )
    eps = float(np.sqrt(max(2 - 2 * threshold, 0.0)))
    found = None
    for dim in sorted(r["dim"] for r in nodes.select("dim").distinct().collect()):
        own = nodes.where(F.col("dim") == dim).select(F.col("node").alias("id"), "copies", "embedding")
        blocks = _blocks(own, _directions(own, dim), eps, scratch)
        part = _links(blocks, _near_blocks(blocks, min(LEADING, dim), eps + MARGIN), dim, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "edge boolean, a bigint, b bigint")
    links = scratch.table(found, "links")
    groups = connected_components(links.where("edge"))
    least = groups.groupBy("root").agg(F.min("node").alias("least"))
    named = by_root(groups, least).select("node", "least")
    counts = links.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    facts = nodes.select("k1", "k2", "node", "copies").join(named, "node", "left").join(counts, "node", "left")
    facts = facts.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "node").alias("least"))
    light = rows.select("id", F.when(F.col("embedding").isNotNull(), F.col("k1")).alias("k1"), "k2")
    out = light.join(facts, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
