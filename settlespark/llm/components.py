"""Connected components of links too many for one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlespark.llm.batches import map_batches
from settlespark.plans.skew import freeze

EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


class UnionFind:
    """Sets of integers; the smallest member is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def _contract(batches, schema: pa.Schema, links: int):
    """Replace the links of a task by one from each node to its root, ``links`` at a time."""
    def out(sets: UnionFind):
        nodes = [n for n in sets.parent if sets.find(n) != n]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([sets.find(n) for n in nodes], pa.int64())], schema=schema)

    sets, held = UnionFind(), 0
    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            sets.join(u, v)
        held += batch.num_rows
        if held >= links:
            yield out(sets)
            sets, held = UnionFind(), 0
    yield out(sets)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every neighbour moves to the smallest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = freeze(
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct())
    # u > v in all edges now
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return freeze(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame, links_per_batch: int = 500_000) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node with a link.

    ``links`` has long columns ``u`` and ``v``.  Tasks first contract their own links
    with a union-find, then star steps run until nothing changes; each step is
    written to the shared folder.  Hot nodes are reached by joins, never gathered.
    """
    edges = freeze(map_batches(links.select("u", "v").filter("u <> v"), _contract, EDGES, links_per_batch))
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state, edges = found, _stars(edges)
    # all edges go from a node to its root now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
