"""Closures, shortest paths and taint over call and dependency graphs.

A frontier is joined with the edges level by level; a node is kept at its
first depth. Lineage is cut per level, depth is always bounded, and edges are
computed and partitioned by source once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only where none is set and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="siftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Words of 64 bits in a mask, and the seeds that share a row of a search: its bits.
WORDS = 16
SEEDS = 64 * WORDS
#: Edges whose masks are held at once, about.
EDGES = 1 << 17


def _masks(column: pa.ChunkedArray) -> np.ndarray:
    """Masks as rows of words."""
    return pc.list_flatten(column).to_numpy().reshape(-1, WORDS)


def _passed(adjacency: pa.Table, frontier: pa.Table) -> pa.Table:
    """(block, node, mask) of the ends of a cell's edges, with the bits of their begins in ``frontier``."""
    names = {"block": pa.int32(), "node": frontier.schema.field("node").type, "mask": pa.list_(pa.int64())}
    out = [pa.table({n: pa.array([], t) for n, t in names.items()})]
    place = pc.index_in(frontier["node"], adjacency["src"])
    frontier, place = frontier.filter(place.is_valid()), place.drop_null().to_numpy()
    if len(place):
        ends = pc.list_flatten(adjacency["dst"]).combine_chunks().dictionary_encode()
        to = ends.indices.to_numpy()
        order = np.argsort(to, kind="stable")
        src = np.repeat(np.arange(len(adjacency), dtype=np.int32), pc.list_value_length(adjacency["dst"]).to_numpy())[order]
        to, masks, block = to[order], _masks(frontier["mask"]), frontier["block"].to_numpy()
        for b in np.unique(block):
            mine = block == b
            # the row of the block's masks that an edge sends, or none
            row = np.full(len(adjacency), -1, np.int32)
            row[place[mine]] = np.arange(mine.sum(), dtype=np.int32)
            sent = row[src]
            live = sent >= 0
            sent, end, own = sent[live], to[live], masks[mine]
            begins = np.flatnonzero(np.diff(end, prepend=-1))
            cuts = np.unique(np.searchsorted(begins, np.arange(0, len(end), EDGES)))
            for i, j in zip(cuts, [*cuts[1:], len(begins)], strict=True):
                if i < j:
                    lo, hi = begins[i], begins[j] if j < len(begins) else len(end)
                    got = np.bitwise_or.reduceat(own[sent[lo:hi]], begins[i:j] - lo, axis=0)
                    mask = pa.ListArray.from_arrays(np.arange(0, got.size + 1, WORDS, dtype=np.int32), got.ravel())
                    out.append(pa.table({"block": pa.array(np.full(j - i, b), pa.int32()), "node": ends.dictionary.take(pa.array(end[begins[i:j]])), "mask": mask}))
    return pa.concat_tables(out)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, node, depth) of rows (node, depth, mask, seeds): a row for each bit."""
    for batch in batches:
        offsets, seeds = batch["seeds"].offsets.to_numpy(), batch["seeds"].values
        bits = _masks(pa.chunked_array([batch["mask"]])).view(np.uint8)
        for at in range(0, len(bits), 256):
            row, bit = np.nonzero(np.unpackbits(bits[at : at + 256], axis=1, bitorder="little"))
            row += at
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([seeds.take(pa.array(offsets[row] + bit)), batch["node"].take(index), batch["depth"].take(index)], ["seed", "node", "depth"])


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, wanted: Column | None = None) -> DataFrame:
    """(seed, node, depth) of every node within ``max_depth`` edges of a seed, the seed at depth 0.

    ``edges`` has src and dst, ``seeds`` a column seed; ``wanted``, a condition
    on node, keeps its nodes only. One row for each pair of a seed and a node:
    for few seeds, or where all pairs are the answer; use :func:`nearest` where
    only the nearest seed counts.

    Seeds are numbered in order and pass over the edges :data:`SEEDS` at a time,
    as the bits of one row. Edges are computed once and lie in cells by the hashes
    of both ends: a level sends a node's bits to the cells that it begins, and a
    cell sends one row for each end, so what is shuffled follows nodes and seeds,
    not edges. One without an end is none.
    """
    from .rounds import numbered

    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, min(4, tasks // 8))
    down = max(1, min(8, tasks // across))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    edges = edges.select(cell("src", down).alias("p"), cell("dst", across).alias("q"), "src", "dst").where("src is not null and dst is not null")
    edges = edges.repartition(down * across, "p", "q").distinct()
    edges = _cut(edges.groupBy("p", "q", "src").agg(F.collect_list("dst").alias("dst")))
    place = numbered(seeds.select("seed").distinct(), [F.col("seed")], name="_n")
    place = _cut(place.select("seed", F.floor((F.col("_n") - 1) / SEEDS).cast("int").alias("block"), ((F.col("_n") - 1) % SEEDS).cast("int").alias("bit")))
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.when(i == F.floor(F.col("bit") / 64), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("bigint")))
    node = edges.schema["src"].dataType
    frontier = _cut(place.select("block", F.col("seed").cast(node).alias("node"), words.alias("mask")))
    found = frontier.withColumn("depth", F.lit(0))
    seen = frontier
    kinds = {"seed": place.schema["seed"].dataType.simpleString(), "node": node.simpleString()}
    for depth in range(1, max_depth + 1):
        sent = frontier.select(cell("node", down).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"), "block", "node", "mask")
        ways = edges
        if wanted is not None and depth == max_depth:
            # nothing follows the last level, so only ends that are wanted count
            ends = edges.select("p", "q", "src", F.explode("dst").alias("node")).where(wanted)
            ways = ends.groupBy("p", "q", "src").agg(F.collect_list("node").alias("dst"))
        step = ways.groupBy("p", "q").cogroup(sent.groupBy("p", "q")).applyInArrow(_passed, f"block int, node {kinds['node']}, mask array<bigint>")
        step = step.groupBy("block", "node").agg(F.array(*[F.bit_or(F.col("mask")[i]) for i in range(WORDS)]).alias("mask"))
        # a node's bits are settled at their first depth
        both = step.join(seen.select("block", "node", F.col("mask").alias("old")), ["block", "node"], "full")
        none = F.array_repeat(F.lit(0).cast("bigint"), WORDS)
        old, got = F.coalesce("old", none), F.coalesce("mask", none)
        new = F.zip_with(got, old, lambda g, o: g.bitwiseAND(F.bitwise_not(o)))
        both = _cut(both.select("block", "node", new.alias("new"), F.zip_with(got, old, lambda g, o: g.bitwiseOR(o)).alias("mask")))
        frontier = both.where(F.exists("new", lambda x: x != 0)).select("block", "node", F.col("new").alias("mask"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
        seen = both.select("block", "node", "mask")
    found = found if wanted is None else found.where(wanted)
    # a block's names lie once for each of its slices, so that no block is one task
    names = place.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "seed"))).getField("seed").alias("seeds"))
    names = names.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    rows = found.withColumn("slice", cell("node", tasks)).join(names, ["block", "slice"])
    return rows.select("node", "depth", "mask", "seeds").mapInArrow(_named, f"seed {kinds['seed']}, node {kinds['node']}, depth int")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def labels(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, label, depth, seed): for each label the least depth at which a seed of it reaches a node, and the least such seed.

    ``seeds`` has label and seed. All labels pass over the edges together; a
    label of a node is settled at its first depth and never sent again, so the
    state has one row per node and label, however many seeds there are, and a
    pass that settles nothing ends the search.
    """
    edges = _cut(edges.select("src", "dst").repartition("src").distinct())
    frontier = _cut(seeds.select(F.col("seed").alias("node"), "label", F.lit(0).alias("depth"), "seed").distinct())
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "label").agg(F.min("seed").alias("seed"))
        frontier = _cut(step.select("node", "label", F.lit(depth).alias("depth"), "seed").join(seen, ["node", "label"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def nearest(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth, seed) of every node within ``max_depth`` edges of any seed, with its nearest seed, the least of equally near ones."""
    return labels(edges, seeds.withColumn("label", F.lit(0)), max_depth).select("node", "depth", "seed")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, callees, callers): distinct nodes on either side of each."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("callee"), F.lit(None).cast(edges.schema["src"].dataType).alias("caller"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["dst"].dataType).alias("callee"), F.col("src").alias("caller")))
    return ends.groupBy("node").agg(F.countDistinct("callee").alias("callees"), F.countDistinct("caller").alias("callers"))


def valid_callees(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct calls whose callee is a node."""
    return calls.distinct().join(nodes.select("callee").distinct(), "callee", "left_semi")


def target_nodes(nodes: DataFrame, file: str, function: str | None = None, line: int | None = None) -> DataFrame:
    """Nodes (path, name, line) of a file, by whole path or its end, and of a function and line where these are given."""
    wanted = F.endswith("path", F.lit(file))
    wanted = wanted & (F.col("name") == function) if function else wanted
    return nodes.where(wanted & (F.col("line") == line) if line else wanted)


def exploitable_sinks(traces: DataFrame) -> DataFrame:
    """Traces of :func:`taint` that an entry reaches and no sanitizer guards."""
    return traces.where(F.col("entry").isNotNull() & ~F.col("sanitized"))


def file_dependencies(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, out_degree, in_degree, centrality) and edges (src, dst, symbol, line) of a project.

    ``imports`` has path, name and line. A name leads to the file of its dotted
    path, to that package's ``__init__``, or to either of its parent, which
    covers names imported from a module; files that nothing joins are nodes too.
    """
    parent = F.regexp_replace("name", r"\.[^.]*$", "")
    paths = lambda c: [F.concat(F.replace(c, F.lit("."), F.lit("/")), F.lit(end)) for end in (".py", "/__init__.py")]
    tried = imports.select("path", "name", "line", F.posexplode(F.array_distinct(F.array(*paths(F.col("name")), *paths(parent)))).alias("rank", "dst"))
    found = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst").where("dst <> path")
    edges = found.groupBy("path", "name").agg(F.min_by("dst", "rank").alias("dst"), F.min("line").alias("line")).select(F.col("path").alias("src"), "dst", F.col("name").alias("symbol"), "line")
    known = degrees(edges.select("src", "dst").distinct())
    nodes = files.select("path").distinct().join(known.withColumnRenamed("node", "path"), "path", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return nodes.select("path", zero("out_degree", 0), zero("in_degree", 0), zero("centrality", 0.0)), edges


def speedup(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: whole over scanned files, files saved and their percentage; no speed-up without files."""
    both = files.select("path").distinct().join(scanned.select("path", F.lit(1).alias("s")).distinct(), "path", "left")
    n = both.agg(F.count("*").alias("original_files"), F.count("s").alias("incremental_files"))
    saved = F.col("original_files") - F.col("incremental_files")
    factor = F.when(F.col("original_files") == 0, 1.0).otherwise(F.coalesce(F.round(F.try_divide(F.col("original_files"), F.col("incremental_files")), 2), F.lit(float("inf"))))
    return n.select("original_files", "incremental_files", saved.alias("files_saved"), factor.alias("speedup_factor"), F.coalesce(F.round(F.try_divide(100 * saved, F.col("original_files")), 1), F.lit(0.0)).alias("time_saved_percent"))


def as_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as JSON rows (kind, value)."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("value")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("value")))


def from_documents(documents: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of one kind of :func:`as_documents`."""
    return documents.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("v")).select("v.*")


def text_callers(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, path, line_no) of lines that call a function by name but do not define it; no graph is needed.

    ``lines`` has path, line_no and line. Called names are cut from the line, so the join is an equality.
    """
    called = F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    defined = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|func|function)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    calls = lines.select("path", "line_no", defined.alias("defined"), F.explode(called).alias("name")).where("name <> defined")
    return calls.join(functions.select("name").distinct(), "name", "left_semi").select("name", "path", "line_no")


def reachability(edges: DataFrame, entries: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """Per target: whether an entry reaches it, the least depth, and a confidence that falls by depth."""
    found = nearest(edges, entries, max_depth).withColumnRenamed("seed", "entry")
    out = targets.join(found, targets["target"] == found["node"], "left")
    confidence = F.when(F.col("depth").isNotNull(), F.round(F.greatest(F.lit(0.3), 1 - 0.1 * F.col("depth")), 6)).otherwise(0.0)
    return out.select("target", F.col("depth").isNotNull().alias("reachable"), "depth", "entry", confidence.alias("confidence"))


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 5) -> DataFrame:
    """(path, score, level) of files that depend on changed ones: one over the distance, 1 for changed files."""
    near = nearest(reversed_edges(edges), changed.select(F.col("path").alias("seed")), max_depth).select(F.col("node").alias("path"), "depth")
    score = F.when(F.col("depth") == 0, 1.0).otherwise(F.round(1 / F.greatest("depth", F.lit(1)), 6))
    level = F.when(F.col("depth") == 0, "changed").when(F.col("depth") <= 1, "direct").when(F.col("depth") == 2, "near").otherwise("far")
    return near.select("path", "depth", score.alias("score"), level.alias("level"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree, and their sum over the greatest sum."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    both = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    top = both.agg(F.max(F.col("out_degree") + F.col("in_degree")).alias("top"))
    return both.crossJoin(F.broadcast(top)).select("node", "out_degree", "in_degree", F.round((F.col("out_degree") + F.col("in_degree")) / F.col("top"), 6).alias("centrality"))


def taint_confidence(length, bonus):
    """0.7 less 0.05 an edge plus a bonus for the entry's type, clamped, and decayed by 0.9 an edge."""
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 - 0.05 * length + bonus))
    return F.round(base * F.pow(F.lit(0.9), length), 6)


# Fixed bonus by entry type.
ENTRY_BONUS = {"http": 0.2, "rpc": 0.15, "cli": 0.1}


def taint(edges: DataFrame, entries: DataFrame, sinks: DataFrame, sanitizers: DataFrame, max_depth: int = 15) -> DataFrame:
    """Per sink: nearest entry backwards, its path length, whether a sanitizer stands nearer, and a confidence.

    ``entries`` has node and kind, ``sanitizers`` node and confidence; one of
    0.6 or more that reaches the sink in fewer edges than the entry sanitizes the
    trace. Entries and sanitizers send their labels forward, so all sinks are
    answered by one search whose state follows the nodes, not sinks times nodes.
    """
    seeds = entries.select(F.lit("entry").alias("label"), F.col("node").alias("seed")).unionByName(sanitizers.where("confidence >= 0.6").select(F.lit("guard").alias("label"), F.col("node").alias("seed")))
    found = labels(edges, seeds, max_depth)
    kinds = entries.groupBy(F.col("node").alias("entry")).agg(F.min("kind").alias("kind"))
    hits = found.where("label = 'entry'").select(F.col("node").alias("sink"), F.col("seed").alias("entry"), F.col("depth").alias("path_length")).join(kinds, "entry")
    guards = found.where("label = 'guard'").select(F.col("node").alias("sink"), F.col("depth").alias("guard_depth"))
    out = sinks.select("sink").distinct().join(hits, "sink", "left").join(guards, "sink", "left")
    from .dims import lookup

    length = F.col("path_length")
    guarded = F.coalesce(F.col("guard_depth") < length, F.lit(False))
    return out.select("sink", "entry", "path_length", guarded.alias("sanitized"), F.coalesce(taint_confidence(length, lookup(F.col("kind"), ENTRY_BONUS, 0.0)), F.lit(0.0)).alias("confidence"))
