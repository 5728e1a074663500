"""Connected components of a graph given as a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlab.llm import common

#: Nodes whose links a task contracts at once.
BLOCK = 200_000


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node of its component.

    Every task first replaces its own links by stars, which takes whole paths out of the graph. Then each round
    points every node at the smallest node it or its neighbours know; the number of rounds grows with the
    logarithm of the longest path that is left. Minima combine before the shuffle, and a node with very many
    links meets them in a join that adaptive execution can split. Links that one task contracts at once, of fewer
    than `BLOCK` nodes, need no rounds.
    """
    u, v = F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")
    edges = common.saved(_contracted(links.select(u, v).where("u <> v")).distinct())
    digest = _digest(edges)
    while digest[0]:
        if 2 * digest[0] < BLOCK:
            edges = common.saved(_contracted(edges.coalesce(1)))
            break
        edges = common.saved(_contracted(_star(_star(edges, upward=True).distinct(), upward=False)).distinct())
        # The tables are distinct, so the same number of edges and the same digest means the same edges.
        before, digest = digest, _digest(edges)
        if digest == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v"))).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def _contracted(edges: DataFrame) -> DataFrame:
    """Links of a task, `BLOCK` at a time, as a star from the smallest node of each of their components."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(node: int) -> int:
            while parent.setdefault(node, node) != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        def stars() -> pa.RecordBatch:
            rows = [(node, find(node)) for node in list(parent)]
            rows = [(node, root) for node, root in rows if node != root]
            parent.clear()
            columns = list(zip(*rows)) or [[], []]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) >= BLOCK:
                yield stars()
        if parent:
            yield stars()

    return edges.mapInArrow(contract, "u long, v long")


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself.

    Upward takes every node's larger neighbours, else its smaller ones; links go from larger to smaller nodes.
    """
    if upward:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if upward:
        linked = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v")
