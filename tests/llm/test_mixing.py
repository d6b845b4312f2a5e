import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagework.llm import mixing


def brute_targets(sizes, weights, epochs=3):
    """The excess of full sources is shared out again and again."""
    total, left, target = sum(sizes.values()), dict(sizes), {}
    while left:
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > epochs * sizes[s] + 1e-9]
        if not full:
            return target | {s: level * weights[s] for s in left}
        for s in full:
            target[s] = epochs * left.pop(s)
    return target


def brute(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, _, s in rows)
    sizes = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target = brute_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = {}
    for s in names:
        before = 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), size[i])):
            reads = sum(size[i] > 0 and k * sizes[s] + before + size[i] / 2 <= target[s] for k in range(3))
            taken[i], before = size[i] * reads, before + size[i]
    return {i: (size[i], sizes[s], pytest.approx(target[s]), taken[i]) for i, _, s in rows}


def mixed(df, **more):
    found = mixing.mix(df, ["doc_id"], "doc_id", **more).select("doc_id", "mix.*").collect()
    return {r["doc_id"]: tuple(r)[1:5] for r in found}, {r["doc_id"]: r["positions"] for r in found}


@pytest.mark.parametrize("bucket_rows", [50_000, 4])
def test_equals_brute_force_however_buckets_fall(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    numbers = random.Random(4)
    sources = ["b", "a", "Z", "é", None, "big", "big", "big"]
    rows = [(i, " ".join("w" * numbers.randrange(40)) if i % 17 else None, numbers.choice(sources)) for i in range(300)]
    rows += [(999, "tiny", "lone"), (1000, "", "empty source")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got, positions = mixed(df)
    assert got == brute(rows)
    assert all(sorted(p) == p and all(0 <= x <= 1 for x in p) for p in positions.values())
    assert all(len(positions[i]) * got[i][0] == got[i][3] for i in got)
    assert mixed(df)[1] == positions


def test_positions_follow_the_schedule(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two' as text", "array('a', 'b', 'c')[id % 3] as source")
    early = {}
    for source, at in mixing.mix(docs, ["doc_id", "source"], "doc_id").selectExpr("source", "explode(mix.positions)").collect():
        early.setdefault(source, []).append(at < 0.5)
    share = {s: sum(x) / len(x) for s, x in early.items()}
    # of weights 1.5 to 0.5, 2 to 2 and 2 to 4, the first half of the time has 5/8, 1/2 and 5/12
    assert share == pytest.approx({"a": 0.625, "b": 0.5, "c": 5 / 12}, abs=0.01)


def test_time_is_the_inverse_of_the_integral(spark):
    schedule = ((0.0, 0.0), (0.25, 4.0), (0.5, 4.0), (1.0, 0.0))

    def reached(t):
        return sum(after if t >= end else before + w * (t - s) + slope * (t - s) ** 2 / 2 - before
                   for (s, w, slope, before, after), end in zip(mixing.segments(schedule), (0.25, 0.5, 1.0)) if s <= t < end)

    for u in (0.0, 0.1, 0.2, 0.5, 0.73, 0.999, 1.0):
        t = spark.range(1).selectExpr(mixing.time_sql(schedule, f"{u}D") + " as t").first()["t"]
        for s, w, slope, before, after in mixing.segments(schedule):
            if before <= u * mixing.integral(schedule) <= after:
                assert before + w * (t - s) + slope * (t - s) ** 2 / 2 == pytest.approx(u * mixing.integral(schedule))


def test_training_order(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('w ', 1 + id % 9) as text", "if(id % 5 = 0, 'x', 'y') as source")
    mixed_docs = mixing.mix(docs, ["doc_id"], "doc_id")
    order = mixing.in_training_order(mixed_docs, "doc_id")
    at = [r["position"] for r in order.collect()]
    assert at == sorted(at) and len(at) == mixed_docs.selectExpr("sum(size(mix.positions))").first()[0]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c", "s")] * 4 + [(None, "a", None)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), ["doc_id"], "doc_id")
    assert found.filter("doc_id = 1").selectExpr("sum(mix.source_size)").first()[0] == 4 * 12
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty, ["doc_id"], "doc_id").collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", "s")], "doc_id bigint, text string, source string")
    assert mixed(blank)[0] == {1: (0, 0, 0.0, 0), 2: (0, 0, 0.0, 0)}
