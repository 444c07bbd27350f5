"""Connected components of an edge table, by repeated contraction.

Every round each node takes the least key among itself and its neighbours as
parent, edges are rewritten to parents, and loops and repeats go. Keys are
hashed anew every round, so about half of the nodes vanish per round whatever
the order of ids. Only keys travel; nothing is gathered on the driver but the
count of edges left. Once no more than FINISH edges are left, a bounded table,
one task joins them by union-find instead of further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

FINISH = 100_000
#: Roots that may travel to every executor.
SHIPPED_ROWS = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; nulls and loops are ignored.

    ``root`` is one node of the component, the same for all its members, but
    not the least; an empty edge table gives an empty result.
    """
    work = cut(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    maps: list[DataFrame] = []
    seed = 0
    while (left := work.count()) > 0:
        if left <= FINISH:
            maps.append(cut(_finished(work)))
            break
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("k"))  # noqa: E731, B023
        ends = work.select("a", "b").union(work.select("b", "a"))
        parent = cut(
            ends.groupBy(F.col("a").alias("node"))
            .agg(F.min(rank("b")).alias("m"))
            .select("node", F.least("m", rank("node"))["k"].alias("parent"))
        )
        maps.append(parent)
        one = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        two = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        work = cut(
            work.join(one, "a")
            .join(two, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    if not maps:
        return work.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(maps[:-1]):
        step = out.select(F.col("node").alias("parent"), "root")
        out = cut(parent.join(step, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")))
    return out


def by_root(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ``groups`` with the facts of their root; few roots travel to the rows, so that a component of very many nodes is not one task."""
    facts = cut(facts)
    return groups.join(F.broadcast(facts) if facts.count() <= SHIPPED_ROWS else facts, "root")


def _finished(edges: DataFrame) -> DataFrame:
    """(node, parent) with the root of each node as parent, by union-find over all edges in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        names = None

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p] if p in parent else p
            return x

        for batch in batches:
            names = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, names), pa.array([find(x) for x in nodes], names)], names=["node", "parent"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"node {kind}, parent {kind}")
