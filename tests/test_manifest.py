import itertools
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.operators import manifest as mf


@pytest.fixture
def manifest(pages):
    return pages.selectExpr("doc_id", "page_no as out_no", "page_no", "rotation")


COUNTS = {1: 1, 2: 3, 3: 9, 4: 12, 5: 17, 6: 30}


def test_split_every_n_tiles_the_document(pages):
    rows = tuples(mf.split_every_n(pages, 4), "doc_id", "part_no", "out_no", "page_no", "output_name")
    for doc_id, n in COUNTS.items():
        mine = [r for r in rows if r[0] == doc_id]
        assert [r[3] for r in sorted(mine, key=lambda r: r[3])] == list(range(1, n + 1))
        assert all((part - 1) * 4 + out == page for _, part, out, page, _ in mine)
    assert (3, 3, 1, 9, "d3_part3_pages9-9.pdf") in rows
    with pytest.raises(ValueError):
        mf.split_every_n(pages, 0)


def test_split_by_ranges_keeps_order_and_overlap(docs, table):
    requests = table(
        "request_id bigint, doc_id bigint, page_ranges array<string>",
        [(1, 2, ["2-3", "1", "2"]), (2, 2, ["1", "9"]), (3, 2, []), (4, 2, None), (5, 99, ["1"])],
    )
    out = mf.split_by_ranges(requests, docs)
    assert tuples(out.rows, "request_id", "part_no", "out_no", "page_no", "output_name") == [
        (1, 1, 1, 2, "d2_part1_pages2-3.pdf"),
        (1, 1, 2, 3, "d2_part1_pages2-3.pdf"),
        (1, 2, 1, 1, "d2_part2_pages1-1.pdf"),
        (1, 3, 1, 2, "d2_part3_pages2-2.pdf"),
    ]
    assert [(r, e) for r, _, e in tuples(out.errors)] == [
        (2, ["Page number 9 is out of range (1-3)"]),
        (3, ["Page ranges are required"]),
        (4, ["Page ranges are required"]),
        (5, ["File not found: 99"]),
    ]


def test_split_at_pages(docs, table, small_blocks):
    requests = table(
        "request_id bigint, doc_id bigint, split_points array<int>",
        [(1, 3, [7, 2]), (2, 3, [9]), (3, 3, [2, 2]), (4, 3, [0]), (5, 3, None), (6, 3, [8])],
    )
    out = mf.split_at_pages(requests, docs)
    names = sorted(set(tuples(out.rows, "request_id", "output_name")))
    assert names == [
        (1, "d3_part1_pages1-2.pdf"),
        (1, "d3_part2_pages3-7.pdf"),
        (1, "d3_part3_pages8-9.pdf"),
        (6, "d3_part1_pages1-8.pdf"),
        (6, "d3_part2_pages9-9.pdf"),
    ]
    assert out.rows.where("request_id = 1").count() == 9
    assert [r for r, _, _ in tuples(out.errors)] == [2, 3, 4, 5]


def removed(n, pages, ranges, even, odd, nth, start):
    gone = set(pages or [])
    for text in ranges or []:
        a, b = map(int, text.split("-"))
        gone |= set(range(a, b + 1))
    gone |= set(range(2, n + 1, 2)) if even else set()
    gone |= set(range(1, n + 1, 2)) if odd else set()
    if nth and nth > 0:
        gone |= {p for p in range(nth if start is None else start, n + 1, nth) if p >= 1}
    return gone


@pytest.mark.parametrize("doc_id", [1, 2, 5, 6])
def test_remove_against_brute_force(docs, table, small_blocks, doc_id):
    rng, n, cases = random.Random(doc_id), COUNTS[doc_id], []
    for even, odd, nth, start in itertools.product([False, True, None], [False, True], [None, 0, 1, 2, 3, 4], [None, -3, 1, 4]):
        pages = [rng.randint(1, n) for _ in range(rng.randint(0, 2))] or None
        low = rng.randint(1, n)
        ranges = [f"{low}-{rng.randint(low, n)}"] if rng.random() < 0.5 else None
        cases.append((pages, ranges, even, odd, nth, start))
    requests = table(
        "request_id bigint, doc_id bigint, pages array<int>, page_ranges array<string>, even boolean, odd boolean,"
        " nth int, start int",
        [(k, doc_id, *case) for k, case in enumerate(cases)],
    )
    out = mf.remove_pages(requests, docs)
    want, errors = [], []
    for k, (pages, ranges, even, odd, nth, start) in enumerate(cases):
        gone = removed(n, pages, ranges, even, odd, nth, start)
        if not (pages or ranges or even or odd or nth is not None):
            errors.append((k, "At least one removal criteria must be specified."))
        elif len(gone) >= n:
            errors.append((k, "Cannot remove all pages from the PDF"))
        else:
            want += [(k, out_no, p) for out_no, p in enumerate([p for p in range(1, n + 1) if p not in gone], 1)]
    assert tuples(out.rows, "request_id", "out_no", "page_no") == sorted(want)
    assert [(r, e[0]) for r, _, e in tuples(out.errors)] == errors


def test_organize(docs, pages, table):
    order = "array<struct<page_number:int,rotation:int>>"
    turned = pages.withColumn("rotation", (pages.page_no % 4 * 90).cast("int"))
    requests = table(
        f"request_id bigint, doc_id bigint, page_order {order}",
        [
            (1, 2, [(3, 0), (1, -90), (1, 450), (2, 720)]),
            (2, 2, [(4, 0), (1, 45)]),
            (3, 2, []),
            (4, 2, [(p, 0) for p in (1, 2, 3)]),
        ],
    )
    out = mf.organize_pages(requests, docs, turned)
    assert tuples(out.rows.where("request_id = 1"), "out_no", "page_no", "rotation") == [
        (1, 3, 270), (2, 1, 0), (3, 1, 180), (4, 2, 180),
    ]
    assert tuples(out.rows.where("request_id = 4"), "out_no", "page_no", "rotation") == [(1, 1, 90), (2, 2, 180), (3, 3, 270)]
    assert tuples(out.errors, "request_id", "errors") == [
        (2, ["Page number 4 is out of range (1-3)", "Rotation must be a multiple of 90 degrees. Got: 45"]),
        (3, ["Page order is required."]),
    ]


def test_rotate_counts_clicks(manifest, table):
    clicks = table("doc_id bigint, out_no int", [(2, 1)] * 5 + [(2, 3)])
    assert tuples(mf.rotate_pages(manifest, clicks).where("doc_id = 2"), "out_no", "rotation") == [(1, 90), (2, 0), (3, 90)]


def marks(seed):
    rng = random.Random(seed)
    chosen = {d: sorted(p for p in range(1, n + 3) if rng.random() < 0.4) for d, n in COUNTS.items()}
    chosen[4] = list(range(1, 13))
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_and_delete_against_lists(manifest, table, small_blocks, seed):
    chosen = marks(seed)
    rows = table("doc_id bigint, out_no int", [(d, p) for d, ps in chosen.items() for p in ps * 2])
    doubled = tuples(mf.duplicate_pages(manifest, rows), "doc_id", "out_no", "page_no")
    deleted = tuples(mf.delete_pages(manifest, rows), "doc_id", "out_no", "page_no")
    want_doubled, want_deleted = [], []
    for d, n in COUNTS.items():
        twice = [p for p in range(1, n + 1) for _ in range(2 if p in chosen[d] else 1)]
        left = [p for p in range(1, n + 1) if p not in chosen[d]] or [n]
        want_doubled += [(d, k, p) for k, p in enumerate(twice, 1)]
        want_deleted += [(d, k, p) for k, p in enumerate(left, 1)]
    assert doubled == sorted(want_doubled)
    assert deleted == sorted(want_deleted)


def test_move_against_lists(docs, manifest, table):
    moves = [(1, 1, 1), (2, 3, 1), (3, 2, 7), (4, 12, 13), (5, 17, 1), (6, 1, 30)]
    got = tuples(mf.move_page(manifest, table("doc_id bigint, from_no int, to_no int", moves)).rows, "doc_id", "out_no", "page_no")
    want = []
    for d, a, b in moves:
        order = list(range(1, COUNTS[d] + 1))
        if b <= COUNTS[d]:
            order.insert(b - 1, order.pop(a - 1))
        want += [(d, k, p) for k, p in enumerate(order, 1)]
    assert got == sorted(want)


def test_merge(docs, table, small_blocks):
    requests = table(
        "request_id bigint, files array<string>",
        [
            (1, ["/in/d2.pdf", "/in/d3.pdf", "/in/d2.pdf"]),
            (2, ["/in/d2.pdf", "/in/no.pdf", "/x.pdf"]),
            (3, None),
            (4, ["/in/d1.pdf"]),
        ],
    )
    out = mf.merge_docs(requests, docs)
    rows = tuples(out.rows, "request_id", "out_no", "doc_id", "page_no")
    order = [(2, p) for p in (1, 2, 3)] + [(3, p) for p in range(1, 10)] + [(2, p) for p in (1, 2, 3)]
    assert rows == [(1, k, d, p) for k, (d, p) in enumerate(order, 1)] + [(4, 1, 1, 1)]
    assert tuples(out.errors, "request_id", "errors") == [
        (2, ["File not found: /in/no.pdf", "File not found: /x.pdf"]),
        (3, ["No files provided."]),
    ]
    assert mf.merge_docs(requests, docs, dedupe=True).rows.where("request_id = 1").count() == 12


def test_one_long_merge_is_expanded_by_many_tasks(spark, table):
    docs = table("doc_id bigint, file_path string, page_count int", [(i, f"/f{i}", 2) for i in range(200)])
    requests = table("request_id int, files array<string>", [(1, [f"/f{i}" for i in range(200)])])
    rows = mf.merge_docs(requests, docs).rows
    assert rows.select(F.spark_partition_id()).distinct().count() > 4
    assert [tuple(r) for r in rows.orderBy("out_no").select("doc_id", "page_no").collect()] == [(i, p) for i in range(200) for p in (1, 2)]
