import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagework.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=10, band=(30, 90)):
    """``rows``: {id: (label, components as whole numbers)}"""
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    clip = lambda s: min((1 << 63) - 1, max(-(1 << 63), s))
    found = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        others = sorted((-score(a, b), b) for b, (_, w) in rows.items() if b != a and len(w) == len(v))
        chosen = [(s, b) for s, b in others if rows[b][0] == label][:positives]
        for s, p in chosen:
            held = [(t, b) for t, b in others if rows[b][0] != label and band[0] * -s <= 100 * -t <= band[1] * -s][:negatives]
            found += [(a, p, r, b, clip(-s), clip(-t)) for r, (t, b) in enumerate(held, 1)]
    return sorted(found)


def mined(df, **more):
    return sorted(tuple(r) for r in hn.mine(df, lambda x: F.floor(256 * x), every=10, **more).collect())


SCHEMA = "vec_id bigint, embedding array<double>, label int, score string"


@pytest.fixture
def small(monkeypatch):
    for name, rows in (("SHARD_ROWS", 40), ("ANCHOR_ROWS", 7), ("AT_ONCE", 3)):
        monkeypatch.setattr(hn, name, rows)


def test_packed_products_are_exact():
    numbers = random.Random(3)
    for dims, top in ((1, 1), (5, 3), (64, 256), (64, 1 << 11), (7, 1 << 28), (3, 1 << 31), (3, 1 << 45), (2, 1 << 60)):
        a = [[numbers.randrange(-top, top + 1) for _ in range(dims)] for _ in range(9)]
        b = [[numbers.randrange(-top, top + 1) for _ in range(dims)] for _ in range(23)]
        kind = np.int64 if top < 1 << 52 else object
        packed = hn.Packed(np.array(b, dtype=kind), max(abs(x) for row in a for x in row))
        assert packed.fields > 1 or packed.width > 32
        assert packed.scores(np.array(a, dtype=kind)).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in b] for p in a]


def test_fields_hold_the_largest_sums():
    for dims in (1, 64):
        for sign in (1, -1):
            packed = hn.Packed(np.full((5, dims), sign * 256), 256)
            assert packed.fields > 1
            assert packed.scores(np.full((2, dims), -256)).tolist() == [[-sign * 65536 * dims] * 5] * 2


def test_brute_force(spark, small):
    numbers = random.Random(11)
    rows = {i: (numbers.choice([0, 0, 0, 1, 2]), [numbers.randrange(-3, 9) / 8 for _ in range(6)]) for i in range(400)}
    rows[20] = (0, rows[10][1])  # equal vectors: ties
    df = spark.createDataFrame([(i, v, label, "x") for i, (label, v) in rows.items()], SCHEMA)
    expected = brute({i: (label, [int(256 * x // 1) for x in v]) for i, (label, v) in rows.items()}, 10)
    assert mined(df) == expected and len(expected) > 500


def test_rows_that_take_no_part(spark, small):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 1), (None, [1.0, 1.0], 0), (5, [1.0, 1.0], None)]
    good = [(0, [1.0, 1.0], 0), (10, [1.0, 0.5], 0), (11, [0.75, 0.0], 1), (12, [0.25, 0.25], 1), (13, [1.0], 1), (14, [0.5, 0.5], 0)]
    again = [(10, [1.0, 0.5], 0), (14, [0.5, 0.5], 0), (14, [0.5, 0.5], 3), (12, [0.25, 0.25], 1)]
    df = spark.createDataFrame([(*r, "x") for r in bad + good + again], SCHEMA)
    expected = brute({i: (label, [int(256 * x) for x in v]) for i, v, label in good}, 10)
    assert mined(df) == expected and {r[1] for r in expected} == {0, 10, 14}


def test_scores_beyond_64_bits(spark, small):
    rows = {0: (0, [1e17, 3.0]), 1: (0, [1e17, 1.0]), 2: (1, [5e16, 1.0]), 3: (1, [5e16, 2.0]), 4: (1, [1e17, 9.0]), 5: (1, [-1e17, 0.0])}
    df = spark.createDataFrame([(i, v, label, "x") for i, (label, v) in rows.items()], SCHEMA)
    found = sorted(tuple(r) for r in hn.mine(df, lambda x: F.floor(x), every=10).collect())
    assert found == brute({i: (label, [int(x) for x in v]) for i, (label, v) in rows.items()}, 10)
    assert [r[3] for r in found] == [3, 2]


def test_few_or_no_rows(spark):
    for rows in ([], [(0, [1.0], 0, "x")], [(0, [1.0], 0, "x"), (1, [1.0], 0, "x")], [(0, None, 0, "x")]):
        assert mined(spark.createDataFrame(rows, SCHEMA)) == []
