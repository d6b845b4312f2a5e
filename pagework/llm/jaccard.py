"""N-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles. MinHash values stand in bands; the number of bands follows from the rows of
a band and the recall wanted at the threshold. Documents that share a band's hash are candidates, and every candidate pair is
verified on the full shingle sets. Documents with equal sets are copies: only one of them, the one with the smallest id, takes
part, and the others follow it. A set has a number of its own, in the order of those ids, so rows that share an id but hold
different texts take part as different sets.

Pairs are never listed. Candidates are put into blocks of a bounded number of documents (near the smallest id they share a
band with), a bucket names the pairs of blocks it joins, and a task verifies one pair of blocks at a time with matrix products
over the shingles that stand in two sets at least. What leaves a task is, for each document, the number of its links and one
edge towards the smallest id it hangs together with. A large group of near copies is thus many block pairs for many tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import slices, written

WORDS, THRESHOLD, RECALL, BAND_ROWS = 5, 0.8, 0.999, 7
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # documents of a block, and their shingles
HOPS = 3  # each doubles the way to the id that a block is named after
COLUMNS = 4096  # shingles of one matrix product
SEED = 20240229

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Bands needed so that a pair at the threshold shares one with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(count: int, salt: int) -> np.ndarray:
    """Fixed odd multipliers."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(SEED + salt)) | np.uint64(1)


POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))  # of a byte's place in its word, repeating
PLACES = _numbers(WORDS, 1)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, words being runs without ASCII white space."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    blank = np.concatenate([[True], SPACE[data], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = mixed((place >> 6).astype(np.uint64) * np.uint64(257) + data[~SPACE[data]]) * POWERS[place & 63]
    return mixed(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of a whole text. A text of one to four words is one shingle of all its
    words; without words there is none."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    count = max(1, len(words) - WORDS + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(min(WORDS, len(words))):
        total += words[i : i + count] * PLACES[i]
    return np.unique(mixed(total + np.uint64(min(WORDS, len(words)))))


def signature(values: np.ndarray, multipliers: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """MinHash values of a set: the least product, as 32 bits, with each multiplier."""
    low = np.full(len(multipliers), 0xFFFFFFFF, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    for start in range(0, len(short), chunk):
        np.minimum(low, (multipliers[:, None] * short[start : start + chunk]).min(axis=1), out=low)
    return low


def digest(found: np.ndarray) -> bytes:
    """Of a shingle set; empty for an empty one."""
    return hashlib.md5(found.tobytes()).digest() if len(found) else b""


def profiles(df: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """id, copies (a digest of the shingle set), size and band hashes of each row with an id; no band without words."""
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null")
    schema = "id bigint, copies binary, size bigint, bands array<bigint>"

    def run(batches):
        multipliers = _numbers(bands * rows, 2).astype(np.uint32) | np.uint32(1)
        lanes, band_seed = _numbers(rows, 3), np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            ids, copies, sizes, counts, hashes = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(t)
                ids.append(i)
                copies.append(digest(found))
                sizes.append(len(found))
                counts.append(bands if len(found) else 0)
                if not len(found):
                    continue
                values = signature(found, multipliers).reshape(bands, rows).astype(np.uint64)
                hashes.append(mixed((values * lanes).sum(axis=1) ^ band_seed).astype(np.int64))
            ends = pa.array(np.cumsum([0, *counts]), pa.int32())
            flat = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["id", "copies", "size", "bands"],
            )

    return source.mapInArrow(run, schema)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets, each with each, by matrix products over the values that stand in two sets."""
    sets = left if right is None else left + right
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = counts[column] > 1
    row, column = row[held], (np.cumsum(counts > 1) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(left)
    total = np.zeros((n, n if right is None else len(right)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        marks = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        marks[row[a:b], column[a:b] - start] = 1
        total += marks[:n] @ (marks if right is None else marks[n:]).T
    return total


def links_of(sizes_a: np.ndarray, sizes_b: np.ndarray, shared: np.ndarray, threshold: float) -> np.ndarray:
    return shared >= threshold * (sizes_a[:, None] + sizes_b[None, :] - shared) - 1e-6


def linked_rows(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float):
    """Of one pair of blocks (or one block with itself, all sides 0): ids, numbers of links, and the least id that each id hangs
    together with inside the pair."""
    size = np.array(list(map(len, sets)), dtype=np.float64)
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    link = np.zeros((len(ids), len(ids)), dtype=bool)
    if len(b):
        part = links_of(size[a], size[b], shared_counts([sets[i] for i in a], [sets[i] for i in b]), threshold)
        link[np.ix_(a, b)] = part
        link[np.ix_(b, a)] = part.T
    else:
        link = links_of(size, size, shared_counts(sets), threshold)
        np.fill_diagonal(link, False)
    least = ids.copy()
    while True:  # least ids spread along links, at most as often as the longest way has links
        spread = np.minimum(least, np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (spread == least).all():
            return ids, link.sum(axis=1), least
        least = spread


def connected(edges: DataFrame) -> DataFrame:
    """(id, least): the least id of the connected component of each id in ``edges`` (id, least). Labels spread over edges and
    jump to their label's label, so the rounds grow with the logarithm of the longest way. Each round is a written table."""
    both = written(
        edges.select(F.col("id").alias("a"), F.col("least").alias("b")).filter("a <> b")
        .union(edges.select(F.col("least").alias("a"), F.col("id").alias("b")).filter("a <> b")).distinct(),
        "links",
    )
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        moved = written(
            spread.join(jump, "label", "left").select("a", "old", F.least("label", F.coalesce("further", "label")).alias("label")),
            "labels",
        )
        labels = moved.select("a", "label")
        if moved.filter("old <> label").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("least"))


def join(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
    rows: int = BAND_ROWS, block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``df`` that has an id: the id (as ``key``), class_id, copy_id, n_links.

    ``copy_id`` is the least id with the same shingle set, ``n_links`` the number of other shingle sets with similarity of at
    least ``threshold``, ``class_id`` the least id of all that hang together by links or as copies. Pairs at the threshold are
    found with probability ``recall``, closer ones with more. Null and wordless texts have no link and are their own class;
    rows with a null id are left out; rows that share an id are told apart by their shingle sets. An empty table gives an empty
    one; other columns are not read."""
    found = classes(df, key, text, threshold, recall, rows, block)
    return found.select(F.col("id").alias(key), "class_id", "copy_id", "n_links")


def classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
    rows: int = BAND_ROWS, block: int = BLOCK,
) -> DataFrame:
    """Like ``join``, with id, copies (the digest of the row's shingle set) and whether the set is ``first`` in its class."""
    bands = bands_for(threshold, recall, rows)
    found = written(profiles(df, key, text, bands, rows), "profiles")
    sets = (
        found.filter("size > 0")
        .groupBy("copies")
        .agg(F.min("id").alias("least_id"), F.min_by("bands", "id").alias("bands"), F.max("size").alias("size"))
        .repartitionByRange("least_id", "copies")
        .sortWithinPartitions("least_id", "copies")
        .withColumn("id", F.monotonically_increasing_id())
    )
    sets = written(sets, "shingle-sets")
    member = sets.select("id", "size", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = member.join(buckets.drop("n"), "bucket").groupBy("id").agg(F.min("hub").alias("hub"), F.max("size").alias("size"))
    near = written(near, "near")
    for _ in range(HOPS):  # the hub's hub, so that a large group has one name and few blocks; links do not depend on it
        further = near.select(F.col("id").alias("hub"), F.col("hub").alias("further"))
        near = written(near.join(further, "hub").select("id", F.col("further").alias("hub"), "size"), "near")
    full = F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_SHINGLES)
    chunks = near.groupBy("hub").agg(F.ceil(full).alias("chunks"))
    blocks = written(
        near.join(chunks, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")), "blocks"
    ).withColumn("block", F.struct("hub", "chunk"))
    inside = sets.join(blocks.select("id", "block"), "id").select(F.explode("bands").alias("bucket"), "block").distinct()
    several = inside.groupBy("bucket").count().filter("count > 1").select("bucket")
    inside = written(inside.join(several, "bucket"), "shared-buckets")
    across = (
        inside.select("bucket", F.col("block").alias("a"))
        .join(inside.select("bucket", F.col("block").alias("b")), "bucket")
        .filter("a < b")
        .select("a", "b")
        .distinct()
    )
    alone = blocks.select(F.col("block").alias("a"), F.col("block").alias("b")).distinct()
    pairs = written(across.union(alone), "block-pairs")
    of = blocks.select("id", "block")
    asked = (
        pairs.join(of.withColumnRenamed("block", "a"), "a").select("a", "b", "id", F.lit(0).alias("side"))
        .union(pairs.filter("a < b").join(of.withColumnRenamed("block", "b"), "b").select("a", "b", "id", F.lit(1).alias("side")))
    )
    named = sets.join(blocks.select("id"), "id", "left_semi").select("id", "copies", F.col("least_id").alias("doc"))
    texts = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(named, "doc")
    stored = written(packed(texts).dropDuplicates(["id"]), "shingles")
    linked = written(verified(asked.join(stored, "id"), threshold), "linked")
    degrees = linked.groupBy("id").agg(F.sum("links").alias("n_links"))
    least = connected(linked.filter("id <> least").select("id", "least"))
    firsts = sets.select(F.col("id").alias("least"), F.col("least_id").alias("class_id"))
    known = (
        sets.select("id", "copies", F.col("least_id").alias("copy_id"))
        .join(degrees, "id", "left")
        .join(least.join(firsts, "least"), "id", "left")
        .select("copies", "copy_id", "n_links", "class_id", F.coalesce(F.col("least") == F.col("id"), F.lit(True)).alias("first"))
    )
    members = found.filter("size > 0").select("id", "copies").join(known, "copies")
    wordless = found.filter("size = 0").select("id", "copies", F.lit(True).alias("first"))
    return members.unionByName(wordless, allowMissingColumns=True).select(
        "id",
        "copies",
        F.coalesce("class_id", "copy_id", "id").alias("class_id"),
        F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "first",
    )


def with_digest(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the digest of each text's shingle set, as ``classes`` has it."""
    source = df.withColumn(into, F.lit(b""))
    place = df.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            found = pa.array([digest(shingles(t)) for t in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=batch.schema.names)

    return source.mapInArrow(run, source.schema)


def packed(texts: DataFrame) -> DataFrame:
    """(id, shingles): the whole shingle set as bytes of each text whose set is the one that ``copies`` names."""

    def run(batches):
        for batch in slices(batches):
            sets = [(i, found.tobytes()) for i, t, c in zip(*(x.to_pylist() for x in batch.columns)) if digest(found := shingles(t)) == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], names=["id", "shingles"]
            )

    return texts.select("id", "text", "copies").mapInArrow(run, "id bigint, shingles binary")


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, least) of the documents of each pair of blocks; ``rows`` has a, b, id, side and shingles."""
    schema = "id bigint, links bigint, least bigint"

    def run(batches):
        pair, held = None, []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != pair:
                    if len(held) > 1:
                        yield answer(held)
                    pair, held = row[0], []
                held.append(row[1:])
        if len(held) > 1:
            yield answer(held)

    def answer(held):
        ids, sides, sets = zip(*held)
        found = linked_rows(np.array(ids), np.array(sides), [np.frombuffer(s, dtype=np.uint64) for s in sets], threshold)
        some = found[1] > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in found], names=["id", "links", "least"])

    keyed = rows.select(F.concat_ws(" ", "a.hub", "a.chunk", "b.hub", "b.chunk").alias("pair"), "id", "side", "shingles")
    return keyed.repartition("pair").sortWithinPartitions("pair", "id").mapInArrow(run, schema)
