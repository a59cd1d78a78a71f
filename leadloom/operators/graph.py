"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut


def _unshuffled(node: Column) -> Column:
    """The number that _shuffled scrambles to this one."""
    low = F.lit(0xFFFFFFFF)
    left, right = F.shiftrightunsigned(node, 32), node.bitwiseAND(low)
    for k in reversed(range(3)):
        left, right = right.bitwiseXOR(F.xxhash64(left, F.lit(k)).bitwiseAND(low)), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def _shuffled(node: Column) -> Column:
    """A one-to-one scramble of 64-bit numbers (a Feistel network over hashes), so that their order tells nothing of the graph."""
    low = F.lit(0xFFFFFFFF)
    left, right = F.shiftrightunsigned(node, 32), node.bitwiseAND(low)
    for k in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


#: Edges that one task may finish: 1.6 MB of pairs.
LAST_EDGES = 100_000


def _finish(edges: DataFrame) -> DataFrame:
    """(from, to): the root of each node of at most LAST_EDGES edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        a, b = ends[: len(table)], ends[len(table) :]
        root = np.arange(len(nodes))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # hook, then shorten
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["from", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "`from` long, to long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): the smallest node reachable from each node of an edge.

    Local contraction: in each round every node goes to the least of its neighbours and itself in a scrambled order,
    and on to where that one goes; edges follow, loops and repetitions drop out. The graph shrinks by a good part in
    each round, whatever its diameter; what fits LAST_EDGES is finished in one task. The rounds' tables, each smaller
    than the one before, are composed from the last to the first, so nodes are joined once. Each is cut at a checkpoint;
    only numbers of edges come to the driver. Loops and repeated edges do no harm; an empty table gives an empty
    result; edges with null ends are left out.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    left = cut(pairs.select(_shuffled(F.col("a")).alias("a"), _shuffled(F.col("b")).alias("b")).distinct())
    given, steps, n = left, [], left.count()
    while n > LAST_EDGES:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("from"), F.least("a", "low").alias("to"))
        on = near.select(F.col("from").alias("to"), F.col("to").alias("further"))
        step = cut(near.join(on, "to", "left").select("from", F.coalesce("further", "to").alias("to")))
        steps.append(step)
        moved = left.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        left = cut(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        n = left.count()
    roots = cut(_finish(left))
    for step in reversed(steps):
        onward = roots.select(F.col("from").alias("to"), F.col("to").alias("root"))
        roots = cut(step.join(onward, "to", "left").select("from", F.coalesce("root", "to").alias("to")))
    nodes = given.select(F.explode(F.array("a", "b")).alias("from")).distinct().join(roots, "from", "left")
    nodes = nodes.select(_unshuffled(F.col("from")).alias("node"), F.coalesce("to", "from").alias("at"))
    return nodes.join(nodes.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component")
