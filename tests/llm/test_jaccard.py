import random
from itertools import combinations

import pytest

from pagework.llm import jaccard


def shingles(text):
    words = (text or "").encode().split()
    count = max(1, len(words) - 4) if words else 0
    return frozenset(tuple(words[i : i + 5]) for i in range(count))


def brute(rows, threshold=0.8):
    """(class, copy, links) of each id by looking at every pair of distinct sets."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    copy = {i: least[s] if s else i for i, s in sets.items()}
    links, up = dict.fromkeys(sets, 0), {i: copy[i] for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations([i for i in sets if copy[i] == i and sets[i]], 2):
        shared = len(sets[a] & sets[b])
        if shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (top(i), copy[i], links[copy[i]]) for i in sets}


@pytest.fixture(scope="module")
def rows():
    """Singles, a chain of ever more changed texts, a large group of near copies, copies, and a passage in many texts."""
    numbers = random.Random(6)
    word = lambda: "".join(numbers.choices("abcdefgh", k=4))
    texts = [" ".join(word() for _ in range(numbers.randrange(1, 90))) for _ in range(60)]
    chain = [word() for _ in range(120)]
    for _ in range(12):
        chain[numbers.randrange(120)] = word()
        texts.append(" ".join(chain))
    seed = [word() for _ in range(150)]
    for _ in range(90):
        near = list(seed)
        near[numbers.randrange(150)] = word()
        texts.append(" ".join(near))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(50))} {passage}" for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[70]] * 5 + ["", None, " \t", "one two", "one two", "one  two", "One two"]
    numbers.shuffle(texts)
    return [*enumerate(texts), (None, texts[0]), (None, None), (0, texts[0])]


@pytest.mark.parametrize("block", [256, 7])
def test_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, class_id string")
    found = jaccard.join(df, block=block).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute(rows)
    assert len(found) == sum(i is not None for i, _ in rows)


def test_long_texts(spark, long_text):
    rows = [(1, long_text), (2, long_text + " end"), (3, long_text)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == brute(rows)


def test_one_id_with_several_texts(spark, rows):
    """Every text of an id takes part: links and classes are those that the texts have under ids of their own."""
    apart = [(2 * i, t) for i, t in rows[:-1] if i is not None]
    expected = sorted((i - i % 4, c - c % 4, k - k % 4, n) for i, (c, k, n) in brute(apart).items())
    df = spark.createDataFrame([(i - i % 4, t) for i, t in apart], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.join(df, block=16).collect())) == expected


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert len(jaccard.join(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()) == 1


def test_bands_reach_the_recall():
    for threshold, recall, rows in [(0.8, 0.999, 7), (0.5, 0.9, 3)]:
        bands = jaccard.bands_for(threshold, recall, rows)
        assert 1 - (1 - threshold**rows) ** bands >= recall > 1 - (1 - threshold**rows) ** (bands - 1)


def test_shared_counts_over_many_columns(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    texts = [" ".join(str(j % 97 + i) for j in range(200)) for i in range(6)]
    sets = [jaccard.shingles(t) for t in texts]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = jaccard.shared_counts(sets)
    for i, j in combinations(range(6), 2):
        assert got[i, j] == expected[i][j]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199)]
    found = dict(jaccard.connected(spark.createDataFrame(edges, "id bigint, least bigint")).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
