"""Approximate nearest neighbours by learned partitions.

Fitting, on a sample of bounded size: a graph of nearest neighbours is cut into partitions of equal size (halved again and
again along the second eigenvector of its random walk, then improved by swaps), and a small classifier learns from a vector
how its neighbours spread over the partitions. Indexing puts every row into its most probable partition. A query goes to its
most probable partitions, until they hold ``coverage`` of the probability, and all rows there are ranked by exact cosine.

A partition may hold most rows: it is cut into chunks of bounded size by id, and the query goes to every chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bounded_sample, spread_key, written
from pagework.llm.vectors import QUERY_ROWS, SHARD_ROWS, best_of_all, matrix, one_of_each_id, prepared, query_set

SAMPLE, PARTITIONS, NEIGHBOURS, COVERAGE, LEAST_PROBES = 4096, 32, 16, 0.97, 3
HIDDEN, STEPS, RATE, DECAY = 64, 400, 0.01, 1e-4
FOUND = "query_id bigint, vec_id bigint, score double"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Scaled by the largest component first, so that no square overflows."""
    largest = np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    scaled = vectors / np.where(largest > 0, largest, 1)
    return scaled / np.maximum(np.sqrt((scaled**2).sum(axis=1, keepdims=True)), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(row, k): the rows of largest cosine, by blocks of rows."""
    k = min(k, len(x) - 1)
    found = []
    for start in range(0, len(x), 1024):
        near = x[start : start + 1024] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        found.append(np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), dtype=int))
    return np.concatenate(found)


def halve(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A half of ``rows``, as a mask: those below the median of the second eigenvector of the walk along ``edges``."""
    at = np.searchsorted(rows, edges)
    degree = np.maximum(1, np.bincount(at.ravel(), minlength=len(rows)))
    value = np.sin(np.arange(1, len(rows) + 1) * 12.9898)  # any fixed start
    for _ in range(100):
        value = value - (value * degree).sum() / degree.sum()
        value /= np.sqrt((value**2).mean()) or 1.0
        spread = np.bincount(at[:, 0], value[at[:, 1]], len(rows)) + np.bincount(at[:, 1], value[at[:, 0]], len(rows))
        value = 0.5 * value + 0.5 * spread / degree
    low = np.zeros(len(rows), dtype=bool)
    low[np.argsort(value, kind="stable")[: len(rows) // 2]] = True
    for _ in range(20):  # swap the pairs whose rows have more neighbours on the other side
        across = low[at[:, 0]] != low[at[:, 1]]
        gain = np.bincount(at[:, 0], 2.0 * across - 1, len(rows)) + np.bincount(at[:, 1], 2.0 * across - 1, len(rows))
        a = np.flatnonzero(low & (gain > 0))
        b = np.flatnonzero(~low & (gain > 0))
        n = min(len(a), len(b)) // 2
        if not n:
            break
        low[a[np.argsort(-gain[a], kind="stable")[:n]]] = False
        low[b[np.argsort(-gain[b], kind="stable")[:n]]] = True
    return low


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """The part, of equal sizes but for one row, of each row of a neighbour graph; ``parts`` is a power of two."""
    part = np.zeros(len(graph), dtype=np.int64)
    edges = np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()], axis=1)
    count = 1
    while count < parts:
        for p in range(count):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                inside = edges[(part[edges] == p).all(axis=1)]
                part[rows[halve(rows, inside)]] = p + count
        count *= 2
    return part


@dataclass
class Router:
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.first + self.first_bias)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = self.hidden(x) @ self.second + self.second_bias
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray) -> Router:
    """One hidden layer, cross entropy with the neighbours' spread over parts, Adam over the whole sample."""
    random = np.random.default_rng(7)
    router = Router(
        random.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, target.shape[1])), np.zeros(target.shape[1]),
    )
    weights = [router.first, router.first_bias, router.second, router.second_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, STEPS + 1):
        hidden = router.hidden(x)
        error = (router.probabilities(x) - target) / len(x)
        back = (error @ router.second.T) * (hidden > 0)
        gradients = [x.T @ back + DECAY * router.first, back.sum(axis=0), hidden.T @ error + DECAY * router.second, error.sum(axis=0)]
        for w, (m, v), g in zip(weights, moments, gradients):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return router


def fit(x: np.ndarray, partitions: int = PARTITIONS, neighbours: int = NEIGHBOURS) -> Router:
    """The router for unit vectors ``x``."""
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(graph, partitions)
    near = np.concatenate([graph, np.arange(len(x))[:, None]], axis=1)
    target = np.zeros((len(x), partitions))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    return train_router(x, target / near.shape[1])


def probes(probability: np.ndarray, coverage: float, least: int) -> np.ndarray:
    """Whether each row goes to each part: the likeliest, until they hold ``coverage``, and ``least`` at any rate."""
    order = np.argsort(-probability, axis=1, kind="stable")
    ranked = np.take_along_axis(probability, order, axis=1)
    wanted = (np.cumsum(ranked, axis=1) - ranked < coverage) | (np.arange(probability.shape[1]) < least)
    chosen = np.zeros_like(wanted)
    np.put_along_axis(chosen, order, wanted, axis=1)
    return chosen


def nearest(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query, id, cosine) of each query's ``k`` nearest other ids. Matrix products choose; what they choose, and all that could
    tie with it, is measured row by row, so equal vectors have equal scores."""
    units, asked = unit(vectors), unit(queries)
    for start in range(0, len(own), 256):
        near = asked[start : start + 256] @ units.T
        near[own[start : start + 256, None] == ids[None, :]] = -np.inf
        count = min(k, near.shape[1])
        border = np.partition(near, -count, axis=1)[:, -count] - 1e-9
        for i, (row, low) in enumerate(zip(near, border), start):
            held = np.flatnonzero((row >= low) & (row > -np.inf))
            score = cosines(queries[i], vectors[held])
            for j in np.lexsort([ids[held], -score])[:k]:
                yield int(own[i]), int(ids[held[j]]), float(score[j])


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    largest = np.abs(query).max(), np.abs(rows).max(axis=1)
    a, b = query / largest[0], rows / largest[1][:, None]
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def search(
    df: DataFrame, k: int, every: int, key: str = "vec_id", vector: str = "embedding", partitions: int = PARTITIONS,
    sample: int = SAMPLE, coverage: float = COVERAGE, least: int = LEAST_PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` rows of other ids with the
    largest cosine among those found, ties to the smaller id; fewer only where there are fewer rows.

    The router learns from at most ``sample`` rows. A query that finds fewer than ``k`` rows in its partitions searches all.
    Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part; rows that share an
    id are one vector, that with the least components. Vectors of different lengths are not compared. The router is that of the
    commonest length (the shorter, of two as common); vectors of any other length are searched among all of their length. An empty
    table gives an empty result."""
    whole = written(prepared(df, key, vector, lambda x: x).filter(F.exists("v", lambda x: x != 0)), "vectors")
    common = whole.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    vectors = whole.filter(F.col("dims") == (common["dims"] if common else -1))
    others = whole.filter(F.col("dims") != common["dims"]) if common else None
    if not common:
        return vectors.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    rows = vectors.select(spread_key("id").alias("order"), "id", "v")
    picked = bounded_sample(rows, "order", sample).toArrow().sort_by([("order", "ascending"), ("id", "ascending")])
    router = fit(unit(matrix(picked, "v")), partitions)
    shared = df.sparkSession.sparkContext.broadcast(router)  # (dims + partitions) x HIDDEN numbers

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            p = shared.value.probabilities(unit(matrix(table, "v"))) if len(table) else np.zeros((0, partitions))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmax(axis=1), pa.int32())], names=["id", "v", "part"])

    def route(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            p = shared.value.probabilities(unit(matrix(table, "v"))) if len(table) else np.zeros((0, partitions))
            parts = [np.flatnonzero(c).tolist() for c in probes(p, coverage, least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["id", "v", "parts"])

    # a part of its own, below zero, for each other length
    placed = vectors.select("id", "v").mapInArrow(place, "id bigint, v array<double>, part int")
    index = written(placed.union(others.select("id", "v", (-F.col("dims")).alias("part"))), "ann-index")
    chunks = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("chunks"))
    chunks = written(chunks, "ann-chunks")  # a row for each partition
    queries = written(query_set(whole, every), "queries")
    usual = F.col("dims") == common["dims"]
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    routed = queries.filter(usual).select("id", "v").mapInArrow(route, "id bigint, v array<double>, parts array<int>")
    routed = routed.union(queries.filter(~usual).select("id", "v", F.array(-F.col("dims"))))
    found = written(_ranked(routed, index, chunks, blocks, k), "ann-found")
    short = queries.filter(usual).select("id", "v").join(found.groupBy("query_id").count().filter(F.col("count") >= k), F.col("id") == F.col("query_id"), "left_anti")
    everywhere = short.withColumn("parts", F.sequence(F.lit(0), F.lit(partitions - 1)))
    rest = _ranked(everywhere, index, chunks, blocks, k)
    return best_of_all(found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(rest), k)


def _ranked(routed: DataFrame, index: DataFrame, chunks: DataFrame, blocks: int, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query in each chunk of its parts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(nearest(left["id"].to_numpy(), matrix(left, "v"), *one_of_each_id(right), k)) if left.num_rows and right.num_rows else []
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    asked = (
        routed.withColumn("block", block).withColumn("part", F.explode("parts")).drop("parts").join(chunks, "part")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    )
    dealt = (
        index.join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).drop("chunks")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    )
    by = ["part", "chunk", "block"]
    return asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(run, FOUND)
