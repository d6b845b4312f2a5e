"""Exact top-k search by inner product: a ball tree in each shard, branch and bound.

A node is a ball around its vectors; the inner product of a query with any of them is at most that with the centre plus the
query's length times the radius. Nodes are opened in order of that bound, and the search ends when the best bound left is
below the k-th score found so far. Shards share that score: in a first round each query searches one shard only, and the k-th
score found there is the floor from which it searches all shards in the second round.

Candidates are dealt to shards of bounded size by id, queries in blocks of bounded size to all shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import written
from pagework.llm.vectors import QUERY_ROWS, best_of_all, matrix, one_of_each_id, prepared, query_set, shards_for

LEAF = 64
EXACT = float(1 << 53)  # whole numbers below are exact as doubles
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id bigint, vec_id bigint, score bigint"


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    start: int
    end: int
    children: tuple[Node, Node] | None = None


class BallTree:
    """``ids`` and rows of ``vectors`` in leaf order below one root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.root = self._build(vectors, 0, len(ids), leaf)
        self.ids, self.vectors = ids[self.order], np.ascontiguousarray(vectors[self.order])
        self.largest = float(np.abs(vectors).max(initial=0))

    def _build(self, vectors: np.ndarray, start: int, end: int, leaf: int) -> Node:
        rows = vectors[self.order[start:end]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = Node(centre, float(away.max(initial=0)), start, end)
        if end - start > leaf:
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            side = rows @ (other - one)
            turn = np.argsort(side, kind="stable")  # halves, so that equal vectors make no deep tree
            self.order[start:end] = self.order[start:end][turn]
            middle = (start + end) // 2
            node.children = (self._build(vectors, start, middle, leaf), self._build(vectors, middle, end, leaf))
        return node

    def scores(self, start: int, end: int, query: np.ndarray, exact: bool) -> np.ndarray:
        rows = self.vectors[start:end]
        if exact:
            return rows @ query
        whole = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
        return np.array([min(HIGHEST, max(LOWEST, s)) for s in whole], dtype=object)

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """At most ``k`` (score, id), best first, of scores not below ``floor``, a whole number or minus infinity; the id ``own`` is
        left out."""
        length = float(np.sqrt(query @ query))
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT
        slack = 1e-9 * (1 + length * (self.largest * max(1, len(query)) ** 0.5))

        def bound(node: Node) -> float:
            return max(LOWEST, float(query @ node.centre) + length * node.radius + slack)  # no score is below

        best: list[tuple[int, int]] = []  # (-score, id) in order
        kth = floor
        open_nodes = [(-bound(self.root), 0, self.root)]
        count = 1
        while open_nodes and -open_nodes[0][0] >= kth:
            _, _, node = heapq.heappop(open_nodes)
            if node.children:
                for child in node.children:
                    if (high := bound(child)) >= kth:
                        heapq.heappush(open_nodes, (-high, count, child))
                        count += 1
                continue
            scores = self.scores(node.start, node.end, query, exact)
            held = np.flatnonzero((scores >= kth) & (self.ids[node.start : node.end] != own))
            if len(held):
                best = sorted(best + [(-int(scores[i]), int(self.ids[node.start + i])) for i in held])[:k]
                if len(best) == k:
                    kth = max(floor, -best[-1][0])
        return [(-s, i) for s, i in best]


def _search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Each (shard, block) of ``queries`` (id, v, floor) against the rows of the shard, which go to every block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree = BallTree(*one_of_each_id(right))
            for own, query, floor in zip(left["id"].to_pylist(), matrix(left, "v"), left["floor"].to_pylist()):
                low = -np.inf if floor is None else floor
                found += [(own, i, s) for s, i in tree.search(own, query, k, low)]
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    by = ["dims", "shard", "block"]
    return queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(run, FOUND)


def top_k(df: DataFrame, k: int, component, every: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` highest inner products with
    rows of other ids, exact, ties to the smaller id; fewer where there are fewer rows.

    ``component`` maps a component to the whole number that is compared. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Rows that share an id are one vector, that with the least components.
    Vectors of different length are not compared. Scores beyond 64 bits stay at the end of the range."""
    vectors = written(prepared(df, key, vector, component), "vectors")
    queries = written(query_set(vectors, every), "queries")
    shards, blocks = shards_for(vectors.count()), max(1, -(-queries.count() // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    candidates = vectors.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    asked = queries.withColumn("block", block).withColumn("floor", F.lit(None).cast("bigint"))
    first = _search(asked.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards))), candidates, k)
    floors = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
    )
    floors = written(floors, "floors").withColumnRenamed("query_id", "id")
    again = asked.drop("floor").join(floors, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    return best_of_all(_search(again, candidates, k), k)
