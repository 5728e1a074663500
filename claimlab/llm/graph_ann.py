"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one for each shard.

Equal vectors become one point that carries its smallest `k + 1` ids (no query can return more of them), so a
vector that very many rows share is searched once. Points are dealt into shards by a hash. With the largest
norm M of the whole table, a point x is extended by sqrt(M^2 - |x|^2) and a query by 0; then the nearest point
of a query is the one of largest inner product.

A shard's graph starts from random edges. In two passes, a beam search from the central point to each point
proposes the points it passes as neighbours; pruning walks the proposals from the nearest on and drops a
proposal that is, by the relaxation factor, nearer to a neighbour already kept than to the point, which leaves
edges of diverse directions. Edges are added in reverse too, and lists that grow too long are pruned again.
Points that can't be reached from the central point get an edge from a reached one.

Queries are packed into blocks and each block is joined with each shard; a beam search runs for all queries of
a block at once, scores are taken in double precision from the original vectors, and the shards' best are
merged. Every row is indexed; no sample is fitted.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as query
or candidate; a query's own id is not returned; rows that repeat an id and its vector count once; vectors of
different length are never compared; fewer candidates than k are all returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common

NEIGHBOURS = 20
QUERY_STRIDE = 20
SHARD_POINTS = 8192
QUERY_BLOCK = 4096
# Partitions of the search; beyond that many meetings of shards and blocks a task has several.
MOST_TASKS = 20_000
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXATION = 32, 64, 96, 1.2
_BRIDGES = 4
_STEP, _EXPANDED = 512, 4


class Graph:
    """Out-neighbours of points, -1 where there are fewer; `points` are the extended vectors."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxation: float = RELAXATION):
        self.points, self.degree = points.astype(np.float32), degree
        self.norms = (self.points**2).sum(axis=1)
        count = len(points)
        self.edges = np.full((count, degree + _BRIDGES), -1, dtype=np.int32)
        centre = self.points.mean(axis=0)
        self.entry = int(np.argmin(((self.points - centre) ** 2).sum(axis=1)))
        random = np.random.default_rng(0)
        if count <= degree + 1:
            for i in range(count):
                self.edges[i, : count - 1] = np.delete(np.arange(count), i)
            return
        self.edges[:, : degree // 2] = random.integers(0, count, (count, degree // 2))
        for factor in (1.0, relaxation):
            order = random.permutation(count)
            for at in range(0, count, _STEP):
                self._insert(order[at : at + _STEP], beam, factor)
        self._reach()

    def distances(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared distances of points `rows` to a matrix of other points."""
        products = np.einsum("bd,bcd->bc", self.points[rows], self.points[others], optimize=True)
        return self.norms[rows][:, None] + self.norms[others] - 2 * products

    def _insert(self, rows: np.ndarray, beam: int, factor: float) -> None:
        found = self.search(self.points[rows], beam)[0]
        proposed = np.concatenate([found, self.edges[rows]], axis=1)
        self._prune(rows, proposed, factor)
        kept = self.edges[rows, : self.degree]
        source = np.repeat(rows, self.degree)[kept.ravel() >= 0]
        target = kept.ravel()[kept.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = min(int(counts.max()), 2 * self.degree)
        extra = np.full((len(ends), width), -1, dtype=np.int32)
        place = np.arange(len(target)) - np.repeat(first, counts)
        inside = place < width
        extra[np.repeat(np.arange(len(ends)), counts)[inside], place[inside]] = source[inside]
        for at in range(0, len(ends), _STEP):
            part = ends[at : at + _STEP]
            self._prune(part, np.concatenate([self.edges[part], extra[at : at + _STEP]], axis=1), factor)

    def _prune(self, rows: np.ndarray, proposed: np.ndarray, factor: float) -> None:
        """Keep diverse proposals as the rows' neighbours."""
        proposed = np.where(proposed == rows[:, None], -1, proposed)
        proposed = np.sort(proposed, axis=1)
        repeated = np.zeros(proposed.shape, dtype=bool)
        repeated[:, 1:] = proposed[:, 1:] == proposed[:, :-1]
        gone = repeated | (proposed < 0)
        own = np.where(gone, np.inf, self.distances(rows, np.maximum(proposed, 0)))
        order = np.argsort(own, axis=1, kind="stable")[:, : 4 * self.degree]
        proposed, own = np.take_along_axis(proposed, order, 1), np.take_along_axis(own, order, 1)
        vectors = self.points[np.maximum(proposed, 0)]
        norms = self.norms[np.maximum(proposed, 0)]
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive, index = np.isfinite(own), np.arange(len(rows))
        result = np.full((len(rows), self.edges.shape[1]), -1, dtype=np.int32)
        for k in range(self.degree):
            pick = alive.argmax(axis=1)
            some = alive[index, pick]
            if not some.any():
                break
            result[some, k] = proposed[index, pick][some]
            alive &= factor * factor * between[index, pick] > own
            alive[index, pick] = False
        self.edges[rows] = result

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest points found, nearest first and -1 beyond, and their squared distances."""
        count, size = len(queries), len(self.points)
        beam = min(beam, size)
        queries = queries.astype(np.float32)
        own = (queries**2).sum(axis=1)
        ids = np.full((count, beam), -1, dtype=np.int32)
        far = np.full((count, beam), np.inf, dtype=np.float32)
        expanded = np.ones((count, beam), dtype=bool)
        seen = np.zeros((count, size), dtype=bool)
        ids[:, 0], expanded[:, 0], seen[:, self.entry] = self.entry, False, True
        far[:, 0] = own + self.norms[self.entry] - 2 * queries @ self.points[self.entry]
        active = np.arange(count)
        while len(active):
            # The nearest unexpanded places of each beam; beams are in order of distance.
            place = np.argsort(expanded[active], axis=1, kind="stable")[:, :_EXPANDED]
            fresh = ~np.take_along_axis(expanded[active], place, 1)
            active, place, fresh = active[fresh[:, 0]], place[fresh[:, 0]], fresh[fresh[:, 0]]
            if not len(active):
                break
            expanded[active[:, None], place] = True
            nodes = np.where(fresh, ids[active[:, None], place], -1)
            near = np.where(nodes[:, :, None] >= 0, self.edges[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            known = (near < 0) | seen[active[:, None], np.maximum(near, 0)]
            near = np.sort(np.where(known, -1, near), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            safe = np.maximum(near, 0)
            seen[np.repeat(active, near.shape[1])[near.ravel() >= 0], near[near >= 0]] = True
            products = np.matmul(self.points[safe], queries[active][:, :, None])[:, :, 0]
            there = np.where(near < 0, np.inf, own[active][:, None] + self.norms[safe] - 2 * products)
            all_far = np.concatenate([far[active], there], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([expanded[active], near < 0], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[active] = np.take_along_axis(all_far, order, 1)
            ids[active] = np.take_along_axis(all_ids, order, 1)
            expanded[active] = np.take_along_axis(all_done, order, 1)
        return np.where(np.isfinite(far), ids, -1), far

    def _reach(self) -> None:
        """Give every point that no path from the entry leads to an edge from one that is reached."""
        reached = np.zeros(len(self.points), dtype=bool)

        def spread(front: np.ndarray) -> None:
            while len(front):
                reached[front] = True
                near = np.unique(self.edges[front])
                near = near[near >= 0]
                front = near[~reached[near]]

        spread(np.array([self.entry]))
        for lost in np.flatnonzero(~reached):
            if reached[lost]:
                continue
            free = np.flatnonzero(reached & (self.edges[:, -1] < 0))
            away = self.norms[free] - 2 * self.points[free] @ self.points[lost]
            helper = free[int(np.argmin(away))]
            self.edges[helper, int(np.argmax(self.edges[helper] < 0))] = lost
            spread(np.array([lost]))


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct usable vectors with their smallest k + 1 ids in ascending order."""
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = _usable(rows).withColumn("place", place).where(F.col("place") <= k + 1)
    return least.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


_INDEX = "dim int, shard int, vectors binary, edges binary, entry int, ids binary, counts binary"


def _indexed(points: DataFrame, longest: float) -> DataFrame:
    """One row for each shard: its vectors, their ids and the graph."""

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        group = group.take(pa.array(np.argsort([i[0] for i in group.column("ids").to_pylist()], kind="stable")))
        vectors = np.array(group.column("vector").to_pylist(), dtype=np.float64).reshape(-1, dim)
        ids = group.column("ids").to_pylist()
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        graph = Graph(np.concatenate([vectors, rest[:, None]], axis=1) / longest)
        values = {
            "dim": [dim],
            "shard": [shard],
            "vectors": [vectors.tobytes()],
            "edges": [graph.edges.tobytes()],
            "entry": [graph.entry],
            "ids": [np.concatenate([np.array(i, dtype=np.int64) for i in ids]).tobytes()],
            "counts": [np.array([len(i) for i in ids], dtype=np.int64).tobytes()],
        }
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({key: pa.array(v, t) for (key, v), t in zip(values.items(), types)})

    return points.groupBy("dim", "shard").applyInArrow(build, _INDEX)


def _nearest(graph: Graph, vectors, ids, counts, queries, query_ids, k: int, beam: int) -> tuple[list, list, list]:
    """The k best (query id, vec_id, score) of a shard, ties to smaller ids; a point stands for all its ids."""
    found = graph.search(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), max(beam, k + 1))[0]
    begin = np.cumsum(np.concatenate([[0], counts]))
    out: tuple[list, list, list] = ([], [], [])
    for query, own, row in zip(queries, query_ids.tolist(), found):
        row = row[row >= 0]
        scores = (vectors[row] * query).sum(axis=1)
        best = np.argsort(-scores, kind="stable")
        # Points up to the k + 1 best scores, and any that tie with the last of them.
        best = best[scores[best] >= scores[best[min(k, len(best) - 1)]]] if len(best) else best
        held = [(-scores[i], v) for i in best for v in ids[begin[row[i]] : begin[row[i] + 1]].tolist() if v != own]
        held.sort()
        for score, other in held[:k]:
            out[0].append(own)
            out[1].append(other)
            out[2].append(-float(score))
    return out


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    shard_points: int = SHARD_POINTS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k found of largest inner product for each row of `queries`."""
    points = common.saved(_points(rows, k)).withColumn("dim", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    count, longest = points.agg(F.count("*"), F.sqrt(F.max(square))).first()
    shards = max(1, -(-count // shard_points))
    longest = (longest or 1.0) * (1 + 1e-9)
    points = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    index = common.saved(_indexed(points, longest))

    asked = _usable(queries).withColumnRenamed("vec_id", "query_id").distinct()
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    packed = asked.groupBy(F.size("vector").alias("dim"), block.alias("block")).agg(
        F.collect_list(F.struct("query_id", "vector")).alias("queries")
    )
    # Each meeting of a shard and a block of queries is a task's work, however few bytes it has.
    tasks, pair = min(shards * blocks, MOST_TASKS), ["dim", "shard", "block"]
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *pair)
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    packed = packed.select("dim", "block", "queries", every_shard).repartition(tasks, *pair)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                dim = one["dim"].as_py()
                vectors = np.frombuffer(one["vectors"].as_buffer(), dtype=np.float64).reshape(-1, dim)
                rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
                graph = Graph.__new__(Graph)
                graph.points = (np.concatenate([vectors, rest[:, None]], axis=1) / longest).astype(np.float32)
                graph.norms = (graph.points**2).sum(axis=1)
                graph.edges = np.frombuffer(one["edges"].as_buffer(), dtype=np.int32).reshape(len(vectors), -1)
                graph.entry = one["entry"].as_py()
                ids = np.frombuffer(one["ids"].as_buffer(), dtype=np.int64)
                counts = np.frombuffer(one["counts"].as_buffer(), dtype=np.int64)
                asked_rows = one["queries"].values
                query_ids = asked_rows.field("query_id").to_numpy()
                flat = asked_rows.field("vector").flatten().to_numpy(zero_copy_only=False)
                asked_vectors = flat.reshape(-1, dim)
                for at in range(0, len(query_ids), _STEP):
                    part = slice(at, at + _STEP)
                    columns = _nearest(graph, vectors, ids, counts, asked_vectors[part], query_ids[part], k, beam)
                    types = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score"]
                    )

    found = spread.join(packed, pair).mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours_of_every_twentieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: rows whose id is divisible by 20 against all rows."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % QUERY_STRIDE == 0))
