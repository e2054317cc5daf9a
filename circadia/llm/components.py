"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from circadia.session import cut_lineage

#: Distinct edges that one task joins at once, in some 40 MB; each round over more of them is several shuffles.
TASK_EDGES = 200_000


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``count`` nodes, for edges a-b inside one task."""
    root = np.arange(count)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:  # every node points to its root's root
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def _in_one_task(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        ends = pa.concat_arrays([p.column(i) for i in (0, 1) for p in parts])
        coded = ends.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[coded.indices.to_numpy()]
        root = local_roots(len(order), at[: len(at) // 2], at[len(at) // 2 :])
        nodes = coded.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(join, f"node {kind}, component {kind}")


def components(edges: DataFrame, max_rounds: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the component is its smallest node.

    Each round connects a node's larger neighbours, then its smaller ones, to the smallest node it
    knows, until nothing changes; edges shrink to one per node. A node with any number of neighbours is
    aggregated before the shuffle and then met in a join that Spark can split. Rounds end in the shared
    checkpoint folder. Reaching ``max_rounds`` raises. Up to ``task_edges`` edges need no rounds: a task
    joins them.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if current.limit(task_edges + 1).count() <= task_edges:
        return cut_lineage(_in_one_task(current))
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut_lineage(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
