"""Hard-negative mining with Kronecker-packed integer products.

Components are whole numbers. Those of several candidates are made non-negative by a bias and packed into separated fields of one
wide integer, component by component. An anchor's component, biased as well, meets each packed number in one multiplication, and
the sums over all components hold one exact product in each field, since a field is wide enough for the largest sum there can
be. What the biases add is known from the sums of components and taken off. Numbers of 64 bits are used where two fields and more
fit; else fields stand in whole numbers of any length, so no score is ever rounded.

Positives come from rows of the anchor's own label, dealt by label to shards of bounded size. Negatives come from all shards; each
(block of anchors, shard) gives at most ``negatives`` rows for an anchor and positive, so what is merged does not grow with a label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import written
from pagework.llm.vectors import matrix, usable

SHARD_ROWS, ANCHOR_ROWS, AT_ONCE = 8192, 4096, 256
WORD = 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, as int64 where all are small and as Python's whole numbers else."""
    if np.abs(x).max(initial=0) < 1 << 52:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class Packed:
    """Candidates, several to a number: ``(component, packed number)``."""

    def __init__(self, candidates: np.ndarray, largest_anchor: int):
        self.rows, dims = candidates.shape
        self.bias, self.anchor_bias = int(np.abs(candidates).max(initial=0)), largest_anchor
        most = max(1, dims) * 2 * self.bias * 2 * self.anchor_bias
        self.width = max(1, most.bit_length())
        self.fields = max(1, WORD // self.width)
        kind = object if self.width > WORD else np.uint64
        if self.width > WORD:
            self.fields = 4
        biased = (candidates.astype(object) if kind is object else candidates) + self.bias
        self.sums = biased.sum(axis=1) if self.rows else np.zeros(0, dtype=np.int64)
        room = np.zeros((-(-self.rows // self.fields) * self.fields, dims), dtype=kind)
        room[: self.rows] = biased
        self.numbers = np.zeros((dims, len(room) // self.fields), dtype=kind)
        for field in range(self.fields):
            self.numbers += room[field :: self.fields].T << (kind(field * self.width) if kind is np.uint64 else field * self.width)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchor, candidate): the exact products, int64, or Python's whole numbers where fields are wider than 64 bits."""
        kind = self.numbers.dtype.type
        exact = object if kind is np.object_ else np.int64
        biased = (anchors.astype(object) if exact is object else anchors) + self.anchor_bias
        total = np.zeros((len(anchors), self.numbers.shape[1]), dtype=self.numbers.dtype)
        biased = biased.astype(total.dtype)
        for component in range(self.numbers.shape[0]):
            total += biased[:, component, None] * self.numbers[component]  # one product for all fields
        found = np.empty((len(anchors), total.shape[1] * self.fields), dtype=exact)
        mask = (1 << self.width) - 1
        for field in range(self.fields):
            shift = field * self.width
            found[:, field :: self.fields] = (total >> (np.uint64(shift) if exact is np.int64 else shift)) & (np.uint64(mask) if exact is np.int64 else mask)
        of_anchors = self.bias * anchors.astype(exact).sum(axis=1)
        return found[:, : self.rows] - self.anchor_bias * self.sums.astype(exact)[None, :] - of_anchors[:, None]


def clipped(score) -> int:
    return min(HIGHEST, max(LOWEST, int(score)))


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def best(scores: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` highest scores among those held, ties to the smaller id."""
    places = np.flatnonzero(held)
    if len(places) > 4 * k and scores.dtype != object:  # those that can't be among them go before the sort
        border = np.partition(scores[places], -k)[-k]
        places = places[scores[places] >= border]
    return sorted(places.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]


def _blocks(left: pa.Table, right: pa.Table):
    """Scores of the anchors of ``left`` with the rows of ``right``, some anchors at a time: (first anchor, scores)."""
    anchors, rows = whole(matrix(left, "v")), whole(matrix(right, "v"))
    packed = Packed(rows, largest(anchors))
    for start in range(0, len(anchors), AT_ONCE):
        yield start, packed.scores(anchors[start : start + AT_ONCE])


def labelled(df: DataFrame, component, key: str, vector: str, label) -> DataFrame:
    """(id, label, dims, v): usable rows, one for each id (that with the least label, then the least components)."""
    rows = df.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.struct(
            label.cast("bigint").alias("label"),
            F.size(vector).alias("dims"),
            F.transform(vector, lambda x: component(x.cast("double")).cast("double")).alias("v"),
        ).alias("row"),
    )
    return rows.filter("row.label is not null").groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def mine(
    df: DataFrame, component, every: int, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90),
    key: str = "vec_id", vector: str = "embedding", label=None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``; their positives the ``positives`` rows of other ids and the same label with
    the highest scores; the negatives of both the ``negatives`` highest rows of other labels whose score, in hundredths of the
    positive's, lies in ``band``. Ties go to the smaller id; fewer rows are given where there are fewer. ``component`` maps a
    component to a whole number, ``label`` is a column (default: label).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that share an id are one, that
    with the least label, then components. Vectors of different lengths are not compared. Scores beyond 64 bits are compared exactly
    and shown at the end of the range. An empty table gives an empty result."""
    rows = written(labelled(df, component, key, vector, F.col("label") if label is None else label), "labelled-vectors")
    anchors = written(rows.filter(F.col("id") % every == 0), "anchors")
    total, asked = rows.count(), anchors.count()
    blocks, shards = max(1, math.ceil(asked / ANCHOR_ROWS)), max(1, math.ceil(total / SHARD_ROWS))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    low, high = band

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own, ids = left["id"].to_numpy(), right["id"].to_numpy()
            for start, scores in _blocks(left, right):
                for i, row in enumerate(scores, start):
                    found += [(int(own[i]), int(ids[j]), str(row[j])) for j in best(row, ids, ids != own[i], positives)]
        return table(found, ("anchor_id", "positive_id"), ("exact",))

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own, mine_, wanted = left["id"].to_numpy(), left["label"].to_numpy(), left["wanted"].to_pylist()
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
            for start, scores in _blocks(left, right):
                for i, row in enumerate(scores, start):
                    differs = labels != mine_[i]
                    for pair in wanted[i]:
                        score = int(pair["exact"])
                        least, most = -(-low * score // 100), high * score // 100
                        held = differs & (row >= max(least, LOWEST) if row.dtype != object else row >= least)
                        held &= row <= min(most, HIGHEST) if row.dtype != object else row <= most
                        places = best(row, ids, held.astype(bool), negatives)
                        found += [(int(own[i]), pair["positive_id"], int(ids[j]), str(score), str(row[j])) for j in places]
        return table(found, ("anchor_id", "positive_id", "negative_id"), ("positive", "exact"))

    def table(found: list[tuple], numbers: tuple[str, ...], texts: tuple[str, ...]) -> pa.Table:
        names = [*numbers, *texts]
        columns = list(zip(*found)) or [()] * len(names)
        return pa.table([pa.array(list(c), pa.int64() if n in numbers else pa.string()) for c, n in zip(columns, names)], names=names)

    # positives: an anchor meets the shards of its label only
    by = ["label", "dims", "shard", "block"]
    sizes = rows.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"))
    sizes = written(sizes, "label-shards")
    inside = rows.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))
    inside = inside.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("shards")
    seeking = anchors.withColumn("block", spread(blocks, 1).cast("int")).join(sizes, ["label", "dims"])
    seeking = seeking.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))).drop("shards")
    near = seeking.groupBy(*by).cogroup(inside.groupBy(*by)).applyInArrow(same, "anchor_id bigint, positive_id bigint, exact string")
    pairs = first(near, ["anchor_id"], "positive_id", positives)
    wanted = pairs.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "exact")).alias("wanted"))  # at most ``positives``
    wanted = written(wanted, "positives").withColumnRenamed("anchor_id", "id")

    by = ["dims", "shard", "block"]
    mining = anchors.join(wanted, "id").withColumn("block", spread(blocks, 1).cast("int"))
    mining = mining.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    outside = rows.withColumn("shard", spread(shards, 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive string, exact string"
    hard = mining.groupBy(*by).cogroup(outside.groupBy(*by)).applyInArrow(other, schema)
    shown = lambda c: F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col(c).cast("decimal(38,0)"))).cast("bigint")
    return first(hard, ["anchor_id", "positive_id"], "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        shown("positive").alias("positive_score"), shown("exact").alias("negative_score"),
    )


def first(found: DataFrame, group: list[str], tie: str, k: int) -> DataFrame:
    """The ``k`` highest of each group by the exact score, which is whole and written in digits, with their rank."""
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("exact").cast("decimal(38,0)")), tie)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
