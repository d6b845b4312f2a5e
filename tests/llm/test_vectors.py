import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagework.llm import ann, mips, vectors

NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floor256(x):
    return F.floor(256 * x)


def brute(rows, k, score):
    best = {}
    for i, v in rows:
        if usable(v) and i is not None and (i not in best or v < best[i]):
            best[i] = v
    return {
        q: sorted(((score(best[q], best[c]), c) for c in best if c != q and len(best[c]) == len(best[q])), key=lambda x: (-x[0], x[1]))[:k]
        for q in best if q % 50 == 0
    }


def whole(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


def by_query(found):
    answer = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        answer.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return answer


@pytest.fixture
def rows():
    numbers = random.Random(1)
    found = [(i, [round(numbers.gauss(0, 1), 1) for _ in range(6)]) for i in range(400)]
    found += [(i, found[3][1]) for i in range(400, 460)]  # ties
    found += [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (551, [NAN] * 6), (552, [INF] * 6), (None, [1.0] * 6)]
    found += [(7, found[7][1]), (50, [9.0, -9.0, 9.0, 0.0, 0.0, 0.0]), (600, [0.0] * 6), (650, [1.0, 2.0]), (651, [2.0, 1.0]), (700, [3.0])]
    return found


@pytest.mark.parametrize("shard,block", [(4096, 2048), (40, 2)])
def test_exact_search_equals_brute_force(spark, rows, monkeypatch, shard, block):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard)
    monkeypatch.setattr(mips, "QUERY_ROWS", block)
    monkeypatch.setattr(mips, "LEAF", 4)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = by_query(mips.top_k(df, 5, floor256, every=50))
    assert got == {q: hits for q, hits in brute(rows, 5, whole).items() if hits}


def test_tree_opens_few_nodes_and_loses_nothing(monkeypatch):
    random_numbers = np.random.default_rng(2)
    points = np.floor(np.concatenate([random_numbers.normal(c, 1, (300, 4)) for c in (0, 40, -40, 90)]))
    tree = mips.BallTree(np.arange(len(points)), points)
    opened = []
    plain = tree.scores
    monkeypatch.setattr(tree, "scores", lambda start, *rest: opened.append(start) or plain(start, *rest))
    for own in range(0, len(points), 97):
        q = points[own]
        s = points @ q
        expected = sorted((-int(s[i]), i) for i in range(len(points)) if i != own)[:5]
        opened.clear()
        assert tree.search(own, q, 5, -np.inf) == [(-a, b) for a, b in expected]
        kth = -expected[-1][0]
        assert tree.search(own, q, 5, kth) == [(-a, b) for a, b in expected]
    assert len(opened) < 24


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e17, 3.0]), (1, [1e17, 1.0]), (2, [1e17, 2.0]), (3, [-1e17, 0.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = by_query(mips.top_k(df, 5, lambda x: F.floor(x), every=50))[0]
    top = (1 << 63) - 1
    assert got == [(top, 1), (top, 2), (10**17 + 3, 4), (-(1 << 63), 3)]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def test_all_partitions_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, part int")
    got = by_query(ann.search(df, 5, every=50, partitions=4, coverage=2.0))
    usable_rows = [(i, v) for i, v in rows if usable(v) and any(v)]
    expected = brute(usable_rows, 5, cosine)
    assert got.keys() == {q for q, hits in expected.items() if hits} and len({len(dict(usable_rows)[q]) for q in got}) > 1
    for q, hits in ((q, expected[q]) for q in got):
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in hits], abs=1e-12)
        assert all(s == pytest.approx(cosine(dict(usable_rows)[q] if q != 50 else min(v for i, v in usable_rows if i == 50), next(v for i, v in usable_rows if i == c)), abs=1e-9) for s, c in got[q] if c != 50)


def test_recall_on_clusters(spark):
    numbers = np.random.default_rng(5)
    centres = numbers.normal(0, 1, (30, 24))
    points = centres[numbers.integers(0, 30, 3000)] + numbers.normal(0, 0.35, (3000, 24))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    got = by_query(ann.search(df, 5, every=50, sample=1500))
    unit = ann.unit(points)
    near = unit[::50] @ unit.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    recall = np.mean([len({c for _, c in got[q * 50]} & set(best[q].tolist())) / 5 for q in range(60)])
    assert recall >= 0.9 and all(len(v) == 5 for v in got.values())


def test_parts_are_balanced():
    numbers = np.random.default_rng(3)
    points = ann.unit(np.concatenate([numbers.normal(c, 0.2, (n, 8)) for c, n in zip(numbers.normal(0, 1, (4, 8)), (400, 100, 40, 60))]))
    graph = ann.neighbour_graph(points, 8)
    part = ann.balanced_parts(graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 2
    kept = (part[graph] == part[:, None]).mean()
    assert kept > 0.6  # of a random cut it would be an eighth


def test_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert by_query(ann.search(few, 5, every=50)) == {0: [(pytest.approx(0.5**0.5), 1), (pytest.approx(0.5**0.5), 2)]}
    assert by_query(mips.top_k(few, 5, floor256, every=50)) == {0: [(256 * 256, 1), (256 * 256, 2)]}
    for rows in ([], [(0, None)], [(0, [1.0])]):
        df = spark.createDataFrame(rows, schema)
        assert ann.search(df, 5, every=50).collect() == [] and mips.top_k(df, 5, floor256, every=50).collect() == []


@pytest.mark.parametrize("shard", [4096, 3])
def test_floors_beyond_doubles_lose_no_hit(spark, monkeypatch, shard):
    """k hits are reached in the first shard, so that a floor is set which no double holds."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard)
    big = 1 << 53
    rows = [(0, [float(big), 1.0]), *((i, [1.0, float(i % 4)]) for i in range(1, 40)), (50, [2.0**62, 2.0]), (60, [4.0, 4.0]), (61, [4.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exact = lambda a, b: min((1 << 63) - 1, max(-(1 << 63), sum(int(x) * int(y) for x, y in zip(a, b))))
    for k in (1, 2, 5):
        assert by_query(mips.top_k(df, k, lambda x: F.floor(x), every=50)) == brute(rows, k, exact)


def test_lengths_are_searched_each_for_itself(spark):
    numbers = np.random.default_rng(8)
    rows = [(i, numbers.normal(0, 1, (8, 3, 5)[i % 3 if i > 90 else 0]).round(2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, expected = by_query(ann.search(df, 4, every=10, partitions=4, coverage=2.0)), {}
    for q, v in rows[::10]:
        expected[q] = sorted(((-cosine(v, w), c) for c, w in rows if c != q and len(w) == len(v)))[:4]
    assert {q: [c for _, c in hits] for q, hits in got.items()} == {q: [c for _, c in hits] for q, hits in expected.items()}
