"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard, beam search in each.

Within a shard inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the shard's
largest norm (0 for queries), which keeps the order. Graphs are built in batches that double: a greedy search of the
graph so far proposes neighbours of each new vector, relaxed pruning keeps diverse ones, and the new edges are put in
both directions. Equal vectors are one node that carries the smallest of their ids, as many as a result can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probita.session import scratch_path

K = 20
DEGREE = 32
BEAM = 96
ALPHA = 1.2
#: There are so many shards at least, and more where they would hold more vectors than the second number.
SHARDS, SHARD_VECTORS = 16, 50_000
QUERY_BLOCK = 4096
#: Vectors searched for at once by a task.
BATCH = 512
#: Nodes of the beam opened in a step.
OPENED = 4


@dataclass
class Graph:
    """Vectors with the added coordinate, up to ``DEGREE`` neighbours each (-1: none), and the node where searches begin."""

    points: np.ndarray
    norms: np.ndarray
    edges: np.ndarray
    entry: int

    def distances(self, rows: np.ndarray, queries: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distance of each of ``rows`` to query ``of``, without the query's own norm."""
        return self.norms[rows] - 2 * np.einsum("ij,ij->i", self.points[rows], queries[of])

    def search(self, queries: np.ndarray, beam: int, valid: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, nearest first (-1: fewer), among the first ``valid`` in order of insertion."""
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.points)), bool)
        nodes = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        nodes[:, 0], far[:, 0], opened[:, 0] = self.entry, self.distances(np.full(n, self.entry), queries, rows), False
        seen[:, self.entry] = True
        active = rows
        while len(active):
            # The nearest unopened nodes of each active query; a row with fewer opens what it has.
            order = np.argsort(opened[active], axis=1, kind="stable")[:, :OPENED]
            fresh = ~np.take_along_axis(opened[active], order, 1)
            opening = np.where(fresh, np.take_along_axis(nodes[active], order, 1), -1)
            np.put_along_axis(picked := opened[active], order, True, 1)
            opened[active] = picked
            reached = np.where(opening[:, :, None] >= 0, self.edges[opening], -1).reshape(len(active), -1)
            at, cell = np.nonzero(reached >= 0)
            node = reached[at, cell]
            keep = ~seen[active[at], node]
            at, node = at[keep], node[keep]
            key = np.unique(at * len(self.points) + node)
            at, node = key // len(self.points), key % len(self.points)
            seen[active[at], node] = True
            # New nodes are put beside the beam, a row each, and the nearest of both stay.
            counts = np.bincount(at, minlength=len(active))
            width = int(counts.max(initial=0))
            if width:
                place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
                more = np.full((len(active), width), -1, np.int64)
                away = np.full((len(active), width), np.inf, np.float32)
                more[at, place], away[at, place] = node, self.distances(node, queries, active[at])
                all_nodes = np.concatenate([nodes[active], more], axis=1)
                all_far = np.concatenate([far[active], away], axis=1)
                all_opened = np.concatenate([opened[active], more < 0], axis=1)
                best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
                nodes[active], far[active] = np.take_along_axis(all_nodes, best, 1), np.take_along_axis(all_far, best, 1)
                opened[active] = np.take_along_axis(all_opened, best, 1)
            active = active[~opened[active].all(axis=1)]
        return nodes, far

    def prune(self, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Up to ``degree`` of each row's candidates (-1: none): the nearest, then the nearest that no kept one is closer to, relaxed by ``alpha``."""
        n, width = candidates.shape
        there = (candidates >= 0) & (candidates != owners[:, None])
        vectors = self.points[candidates]
        own = self.norms[owners][:, None] + self.norms[candidates] - 2 * np.einsum("ijk,ik->ij", vectors, self.points[owners])
        own = np.where(there, np.maximum(own, 0), np.inf)
        order = np.argsort(own, axis=1, kind="stable")
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        norms = self.norms[candidates]
        between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1)), 0)
        alive, kept, rows = np.isfinite(own), np.full((n, degree), -1, np.int64), np.arange(n)
        for slot in range(degree):
            first = alive.argmax(axis=1)
            any_left = alive[rows, first]
            if not any_left.any():
                break
            kept[:, slot] = np.where(any_left, candidates[rows, first], -1)
            alive &= (alpha * alpha * between[rows, first] > own) | ~any_left[:, None]
            alive[rows, first] = False
        return kept


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
    """A graph over the vectors; any number of them, none included."""
    n = len(vectors)
    squares = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
    added = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))
    points = np.concatenate([vectors, added[:, None]], axis=1).astype(np.float32)
    graph = Graph(points, np.einsum("ij,ij->i", points, points), np.full((max(n, 1), degree), -1, np.int64), 0)
    if n == 0:
        return graph
    graph.entry = int((graph.norms - 2 * (points @ points.mean(axis=0))).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([graph.entry], order[order != graph.entry]))
    done = 1
    while done < n:
        batch = order[done:done + min(done, BATCH, n - done)]
        found, _ = graph.search(points[batch], beam, done)
        found = np.concatenate([found, np.tile(graph.entry, (len(batch), 1))], axis=1)
        found[(found == graph.entry) & (np.arange(found.shape[1]) < found.shape[1] - 1)] = -1
        graph.edges[batch] = graph.prune(batch, found, degree, alpha)
        _link_back(graph, batch, degree, alpha)
        done += len(batch)
    return graph


def _link_back(graph: Graph, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the new nodes to the lists of their neighbours and prunes lists that grow too long, ``degree`` additions at a time."""
    target = graph.edges[batch]
    source = np.repeat(batch, degree)[(target >= 0).ravel()]
    target = target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    while len(target):
        first = np.concatenate(([0], np.flatnonzero(target[1:] != target[:-1]) + 1))
        sizes = np.diff(np.concatenate((first, [len(target)])))
        place = np.arange(len(target)) - np.repeat(first, sizes)
        now = place < degree
        nodes = target[first]
        added = np.full((len(nodes), degree), -1, np.int64)
        added[np.repeat(np.arange(len(nodes)), sizes)[now], place[now]] = source[now]
        for at in range(0, len(nodes), BATCH):
            some = nodes[at:at + BATCH]
            both = np.concatenate([graph.edges[some], added[at:at + BATCH]], axis=1)
            full = (both >= 0).sum(axis=1) > degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            if full.any():
                packed[full] = graph.prune(some[full], both[full], degree, alpha)
            graph.edges[some] = packed
        target, source = target[~now], source[~now]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, not zero, no component NULL or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.empty(0)]).reshape(rows, -1)


def search(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, degree: int = DEGREE,
           beam: int = BEAM, alpha: float = ALPHA, shards: int = SHARDS, shard_vectors: int = SHARD_VECTORS, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that ``queries`` (over ``id`` and ``v``) selects the ``k`` nearest other rows found.

    Nearness is the inner product in double precision on the vectors as given; ties go to the smaller id; a query finds
    all rows where there are fewer than ``k``, and copies of its vector under other ids. Rows whose vector is NULL, zero
    or not finite, or whose id is NULL, take no part, nor do vectors of another length than most. Of rows with equal ids
    and vectors one counts. Other columns are not read. A shard holds a bounded number of distinct vectors and is built and searched by a task
    of its own; queries come to it in bounded blocks.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "graphs")
    taken = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = taken.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length, total = (sizes[0].n, sizes[0]["count"]) if sizes else (1, 0)
    taken = taken.where(F.size("v") == length)
    n_shards = max(shards, -(-total // shard_vectors))
    # Only the k + 1 smallest ids of equal vectors can be in a result of k: those that tie come by id, and one may be the query itself.
    smallest = taken.select("v", "id").distinct().withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    nodes = smallest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int"))

    def built(table: pa.Table) -> pa.Table:
        matrix = _matrix(table.column("v"), table.num_rows)
        ids = table.column("ids").combine_chunks()
        graph = build(matrix, degree, beam, alpha)
        return pa.table({"shard": table.column("shard")[:1], "length": pa.array([matrix.shape[1]], pa.int32()), "vectors": pa.array([matrix.tobytes()], pa.binary()),
                         "edges": pa.array([graph.edges.astype(np.int32).tobytes()], pa.binary()), "entry": pa.array([graph.entry], pa.int32()),
                         "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()), "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary())})

    nodes.repartition(4 * n_shards, "shard").groupBy("shard").applyInArrow(
        built, "shard int, length int, vectors binary, edges binary, entry int, ids binary, counts binary").write.parquet(path)
    asked = taken.where(queries).select("id", "v").distinct()
    n_blocks = max(1, -(-asked.count() // block))
    tasks = min(4 * n_shards * n_blocks, 20_000)
    index = spark.read.parquet(path).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, "shard", "block")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).repartition(tasks, "shard", "block")

    def searched(shard: pa.Table, block: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not shard.num_rows or not block.num_rows:
            return kinds.empty_table()
        row = {c: shard.column(c)[0].as_py() for c in shard.column_names}
        matrix = np.frombuffer(row["vectors"]).reshape(-1, row["length"])
        squares = np.einsum("ij,ij->i", matrix, matrix)
        points = np.concatenate([matrix, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)
        graph = Graph(points, np.einsum("ij,ij->i", points, points), np.frombuffer(row["edges"], np.int32).reshape(len(matrix), -1).astype(np.int64), row["entry"])
        counts = np.frombuffer(row["counts"], np.int32)
        ids, starts = np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(counts)))
        wanted, names = _matrix(block.column("v"), block.num_rows), block.column("id").to_numpy()
        out = []
        for at in range(0, len(wanted), BATCH):
            some, own = wanted[at:at + BATCH], names[at:at + BATCH]
            found, _ = graph.search(np.concatenate([some, np.zeros((len(some), 1))], axis=1).astype(np.float32), beam, len(matrix))
            found = found[:, :2 * k]
            who, cell = np.nonzero(found >= 0)
            node = found[who, cell]
            score = np.einsum("ij,ij->i", matrix[node], some[who])
            # A node stands for its copies.
            spread = np.repeat(np.arange(len(node)), counts[node])
            copy = ids[np.arange(len(spread)) - np.repeat(np.cumsum(counts[node]) - counts[node], counts[node]) + starts[node][spread]]
            who, score = who[spread], score[spread]
            other = copy != own[who]
            who, score, copy = who[other], score[other], copy[other]
            order = np.lexsort((copy, -score, who))
            who, score, copy = who[order], score[order], copy[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
            top = rank < k
            out.append(pa.table([own[who[top]], copy[top], score[top]], schema=kinds))
        return pa.concat_tables(out)

    near = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(searched, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
