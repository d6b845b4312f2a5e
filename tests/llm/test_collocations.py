import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagework.llm import collocations as co

SCHEMA = "doc_id bigint, text string, lang string, n bigint"


def brute(rows, least, top, percent=100):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, f in counts.items():
        several = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in several.items():
            inside = lambda o: any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))
            if any(len(o) > len(p) and 100 * b >= percent * a and inside(o) for o, b in several.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(found)


def texts(seed=3, count=160):
    numbers = random.Random(seed)
    vocabulary = ["The", "of", "é", "Ü", "a", "b", "c", "x y", "\x1c", "�", "𝄞", "the"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!", "?;", "\x0b", ":"]
    for i in range(count):
        words = (numbers.choice(vocabulary) if numbers.random() < 0.8 else "red fox jumps over it" for _ in range(numbers.randrange(0, 60)))
        yield "".join(w + numbers.choice(marks) for w in words), numbers.choice(["en", "en", "de", None])


def found(df, **more):
    return sorted(tuple(r) for r in co.collocations(df, **more).collect())


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i if i % 5 else None, t, lang, 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(6)


def test_brute_force(table, long_text):
    rows = [*texts(), (None, "en"), ("", None), (" \t", "de"), (long_text, "fr"), (long_text, "fr"), ("w" * 70_000 + " w" * 50, "es")]
    for least, top in ((12, 10_000), (5, 7)):
        expected = brute(rows, least, top)
        assert found(table(rows), least=least, top=top) == expected and len(expected) > 10
    assert {r[0] for r in expected} == {"en", "de", "und", "fr", "es"}


def test_colliding_fingerprints_change_nothing(table):
    rows = list(texts(7))
    expected = brute(rows, 9, 500)
    for bits in (3, 9):
        phrases, _ = co.frequent_phrases(table(rows), 9, bits=bits)
        whole, _ = co.frequent_phrases(table(rows), 9)
        assert sorted(map(tuple, phrases.collect())) == sorted(map(tuple, whole.collect()))
    assert found(table(rows), least=9, top=500) == expected


def test_groups_part_phrases_that_share_a_fingerprint():
    groups, totals = co.Groups(2), Counter()
    prints, words = np.array([7, 7, 7, 9], np.uint64), np.array([[0, 1, 2], [0, 2, 1], [0, 1, 2], [0, 1, 2]])
    ones, rows = np.ones(4, np.int64), np.arange(4)
    for _ in range(2):
        groups.add(prints, words, ones, rows, rows)
    sizes, found, digests, counts, _, _ = groups.out([co.BREAK, b"a", b"b"], ["en"])
    for p, d, n in zip(found.tolist(), digests.tolist(), counts.tolist()):
        totals[p, d] += n
    assert sorted((p, n) for (p, _), n in totals.items()) == [(7, 2), (7, 4), (9, 2)] and set(sizes.tolist()) == {2}
    assert groups.out([], []) is None


def test_packed_groups_add_up(spark):
    numbers = np.random.default_rng(2)
    columns = [numbers.integers(1, 3, 500, np.int32), numbers.integers(-9, 9, 500), numbers.integers(0, 3, 500), numbers.integers(1, 5, 500),
               numbers.integers(0, 50, 500), numbers.integers(0, 9, 500, np.int32)]
    batches = [co.packed([c[i::4] for c in columns], 5) for i in range(4)]
    df = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], co.PACKED)
    expected, pointer = Counter(), {}
    for size, p, d, n, row, at in zip(*(c.tolist() for c in columns)):
        expected[size, p, d] += n
        pointer[size, p, d] = min(pointer.get((size, p, d), (99, 99)), (row, at))
    found = sorted(map(tuple, co.add_up(df, 12).collect()))
    assert found == sorted((key[0], n, *pointer[key]) for key, n in expected.items() if n >= 12) and found


def test_fingerprints_are_polynomials():
    values = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    prefix = co.prefixes(values)
    for start, size in ((0, 1), (0, 50), (7, 5), (49, 1), (20, 0)):
        plain = sum(int(v) * pow(co.BASE, size - 1 - i, 1 << 64) for i, v in enumerate(values[start : start + size])) % (1 << 64)
        assert int(co.spans(prefix, np.array([start]), size)[0]) == plain
    assert len(set(co.codes_of([b"a", b"aa", b"\x00", b"\x00\x00", b"ab", b"ba", b""]).tolist())) == 7


def test_scores_beyond_64_bits(spark):
    """The products of a score as the query writes them."""
    a, n, left, right = 9 * 10**12, 8 * 10**14, 3 * 10**13, 7 * 10**12
    row = spark.sql(f"select cast(1000 * cast({a} as decimal(19,0)) as decimal(19,0)) * cast({n} as decimal(19,0)) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0))) as s")
    assert row.first()["s"] == 1000 * a * n // (left * right)


def test_empty_tables(table, spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(table([("a b c", "en"), (None, None)])) == []
