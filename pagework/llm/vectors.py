"""What the two vector searches share: usable vectors, query sets, and the best rows over all shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 4096, 2048


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite


def prepared(df: DataFrame, key: str, vector: str, component) -> DataFrame:
    """(id, dims, v): usable vectors with an id, their components mapped as doubles."""
    return df.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.size(vector).alias("dims"),
        F.transform(vector, lambda x: component(x.cast("double")).cast("double")).alias("v"),
    )


def query_set(vectors: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``; of rows that share an id the one with the least components."""
    return vectors.filter(F.col("id") % every == 0).groupBy("id", "dims").agg(F.min("v").alias("v"))


def shards_for(rows: int) -> int:
    return max(1, math.ceil(rows / SHARD_ROWS))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = table[column].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1 if len(flat) else 0), dtype=np.float64)


def one_of_each_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors; of rows that share an id the one with the least components."""
    ids, vectors = table["id"].to_numpy(), matrix(table, "v")
    order = np.lexsort([*vectors.T[::-1], ids])
    ids, vectors = ids[order], vectors[order]
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, dtype=bool)
    return ids[first], np.ascontiguousarray(vectors[first])


def best_of_all(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id. Each shard gives at most ``k`` rows a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
