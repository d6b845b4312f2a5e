import itertools
import random

import pytest
from conftest import tuples

from pagework.operators import selection as sl


def pick(docs, table, dialect, doc_id, **fields):
    """Pages and errors of one request."""
    kinds = {"pages": "array<int>", "page_ranges": "array<string>"}
    schema = ", ".join(["request_id bigint", "doc_id bigint", *[f"{f} {kinds.get(f, 'string')}" for f in fields]])
    good, bad = sl.parse_page_spec(table(schema, [(1, doc_id, *fields.values())]), docs, dialect)
    chosen = [p for _, _, p in tuples(sl.selected_pages(good))]
    return chosen, [e for r in bad.collect() for e in r.errors]


# Document 3 has nine pages.
@pytest.mark.parametrize(
    "token, pages, error",
    [
        (" 3 ", [3], None),
        ("+4", [4], None),
        ("2-4", [2, 3, 4], None),
        (" 2 - 4 ", [2, 3, 4], None),
        ("0", [], "Page number 0 is out of range (1-9)"),
        ("10", [], "Page number 10 is out of range (1-9)"),
        ("x", [], "Invalid page number: 'x'"),
        ("", [], "Invalid page number: ''"),
        ("1_0", [], "Invalid page number: '1_0'"),
        ("99999999999", [], "Invalid page number: '99999999999'"),
        ("1-2-3", [], "Invalid range format: '1-2-3'. Use 'start-end' or single page numbers."),
        ("-3", [], "Invalid page numbers in range: '-3'"),
        ("a-3", [], "Invalid page numbers in range: 'a-3'"),
        ("0-3", [], "Start page cannot be less than 1: '0-3'"),
        ("2-10", [], "End page cannot exceed 9: '2-10'"),
        ("5-2", [], "Start page cannot be greater than end page: '5-2'"),
    ],
)
def test_split_dialect(docs, table, token, pages, error):
    assert pick(docs, table, "split", 3, page_ranges=[token]) == (pages, [error] if error else [])


@pytest.mark.parametrize(
    "token, pages, error",
    [
        ("2-4", [2, 3, 4], None),
        (" 2 - 2 ", [2], None),
        ("3", [], "Invalid page range format: 3. Expected format: 'start-end' (e.g., '1-5')"),
        ("a-b", [], "Invalid page numbers in range: a-b"),
        ("0-2", [], "Page range 0-2 is out of bounds (1-9) or invalid"),
        ("2-10", [], "Page range 2-10 is out of bounds (1-9) or invalid"),
        ("5-2", [], "Page range 5-2 is out of bounds (1-9) or invalid"),
    ],
)
def test_remove_dialect(docs, table, token, pages, error):
    assert pick(docs, table, "remove", 3, pages=None, page_ranges=[token]) == (pages, [error] if error else [])


def test_remove_page_list(docs, table):
    assert pick(docs, table, "remove", 3, pages=[2, 2, 5], page_ranges=["4-5"]) == ([2, 4, 5], [])
    assert pick(docs, table, "remove", 3, pages=[0, 12], page_ranges=["x"])[1] == [
        "Page number 0 is out of range (1-9)",
        "Page number 12 is out of range (1-9)",
        "Invalid page range format: x. Expected format: 'start-end' (e.g., '1-5')",
    ]


@pytest.mark.parametrize(
    "text, pages",
    [
        ("5-2", [2, 3, 4, 5]),
        ("--2-4", [2, 3, 4]),
        ("-3", []),
        ("5-", []),
        ("x,4,,7-99", [4, 7, 8, 9]),
        ("1-2-3", []),
        ("3abc", []),
        (" 2 ", [2]),
        ("1- -3", []),
    ],
)
def test_crop_dialect(docs, table, text, pages):
    assert pick(docs, table, "crop", 3, custom_pages=text) == (pages, [])


@pytest.mark.parametrize(
    "text, pages",
    [
        ("5-2", []),
        ("--2-4", []),
        (" 1 - 2 , 8 ", [1, 2, 8]),
        ("8-99999999999999999999999", [8, 9]),
        ("-99999999999999999999999", []),
        ("0-1", [1]),
        ("x,4,5-,6", [4, 6]),
        ("1-2-3", []),
        ("1,1-3,2-4", [1, 2, 3, 4]),
    ],
)
def test_watermark_dialect(docs, table, text, pages):
    assert pick(docs, table, "watermark", 3, custom_pages=text) == (pages, [])


@pytest.mark.parametrize(
    "listed, ranges, pages",
    [
        (None, None, list(range(1, 10))),
        ([], [], list(range(1, 10))),
        ([0, 3, 99], None, [3]),
        (None, ["2", "4-3", "8-20"], [2, 8, 9]),
        (None, ["1-2-3", "-2", "7-"], []),
        ([99], [], []),
    ],
)
def test_image_dialect(docs, table, listed, ranges, pages):
    assert pick(docs, table, "images", 3, pages=listed, page_ranges=ranges) == (pages, [])


@pytest.mark.parametrize(
    "numbers, ranges, pages",
    [
        ("3abc, 5.9,0x2,-1,abc", "", [2, 3, 5]),
        ("10,9", "", [9]),
        ("", "2-4x, 7 - 8", [2, 3, 4, 7, 8]),
        ("", "8-10,0-2,5-2,6,1-2-3", []),
        ("0x", "0x1-0X2", [1, 2]),
    ],
)
def test_form_dialect(docs, table, numbers, ranges, pages):
    assert pick(docs, table, "form", 3, pages_text=numbers, ranges_text=ranges) == (pages, [])


def test_missing_document(docs, table):
    assert pick(docs, table, "crop", 77, custom_pages="1") == ([], ["File not found: 77"])
    assert pick(docs, table, "split", 77, page_ranges=["1"]) == ([], ["File not found: 77"])


@pytest.mark.parametrize(
    "mode, custom, start, end, pages",
    [
        ("all", "", 1, 0, list(range(1, 10))),
        ("first", "", 5, 6, [1]),
        ("last", "", 1, 0, [9]),
        ("custom", "2,4", 1, 0, [2, 4]),
        ("custom", "", 7, 0, [7, 8, 9]),
        ("range", "2", -3, 2, [1, 2]),
        ("range", "", 8, 99, [8, 9]),
        ("range", "", 5, 4, []),
    ],
)
def test_modes(docs, table, mode, custom, start, end, pages):
    requests = table(
        "request_id bigint, doc_id bigint, mode string, custom_pages string, start_page int, end_page int",
        [(1, 3, mode, custom, start, end)],
    )
    assert [p for _, _, p in tuples(sl.selected_pages(sl.select_pages(requests, docs).rows))] == pages


def test_strides_against_brute_force(docs, table, small_blocks):
    cases = list(itertools.product([True, False, None], [True, False], [None, 0, 1, 2, 3, 5], [None, -4, 0, 2, 7]))
    requests = table(
        "request_id bigint, doc_id bigint, even boolean, odd boolean, nth int, start int",
        [(k, 5, *case) for k, case in enumerate(cases)],
    )
    want = []
    for k, (even, odd, nth, start) in enumerate(cases):
        begin = nth if start is None else start
        stride = set(range(begin, 18, nth)) if nth and nth > 0 else set()
        want += [(k, 5, p) for p in range(1, 18) if even and p % 2 == 0 or odd and p % 2 == 1 or p in stride]
    assert tuples(sl.select_stride(requests, docs).rows) == sorted(want)


@pytest.fixture
def random_selection(table):
    rng = random.Random(7)
    rows = [(d, d, p) for d, n in {3: 9, 4: 12, 5: 17, 6: 30}.items() for p in range(1, n + 1) if rng.random() < 0.7]
    return table("request_id bigint, doc_id bigint, page_no int", rows)


def test_compact_then_expand_is_the_same(random_selection, small_blocks):
    compact = sl.compact_selection(random_selection.union(random_selection))
    spread = compact.selectExpr("request_id", "doc_id", "explode(sequence(start_page, end_page)) as page_no")
    assert tuples(spread) == tuples(random_selection)
    runs = tuples(compact, "doc_id", "start_page", "end_page", "kind", "token")
    for doc_id, start, end, kind, token in runs:
        assert (kind, token) == (("range", f"{start}-{end}") if end - start >= 2 else ("page", str(start)))
    # Ranges are as long as they can be: no two touch.
    ranges = [(d, s, e) for d, s, e, kind, _ in runs if kind == "range"]
    pages = {(d, p) for d, _, p in tuples(random_selection)}
    assert all((d, s - 1) not in pages and (d, e + 1) not in pages for d, s, e in ranges)


def test_one_long_run_over_many_blocks(table, small_blocks):
    whole = table("request_id bigint, doc_id bigint, page_no int", [(1, 1, p) for p in range(2, 40)])
    assert tuples(sl.compact_selection(whole), "token") == [("2-39",)]


def test_invert_twice_is_the_same(docs, random_selection, table, small_blocks):
    requests = table("request_id bigint, doc_id bigint", [(d, d) for d in (3, 4, 5, 6)])
    once = sl.invert_selection(requests, docs, random_selection).rows
    assert not set(tuples(once)) & set(tuples(random_selection))
    assert tuples(sl.invert_selection(requests, docs, once).rows) == tuples(random_selection)


def test_union_has_no_repeats(random_selection):
    assert tuples(sl.union_selection(random_selection, random_selection)) == tuples(random_selection)


def test_summary_lists_ten_pages_at_most(docs, table):
    requests = table("request_id bigint, doc_id bigint", [(1, 6), (2, 6), (3, 6), (4, 6)])
    chosen = table(
        "request_id bigint, doc_id bigint, page_no int",
        [(1, 6, 12)] + [(2, 6, p) for p in range(10, 0, -1)] * 2 + [(3, 6, p) for p in range(1, 12)],
    )
    got = tuples(sl.selected_summary(requests, docs, chosen).rows, "request_id", "selected_count", "remaining", "info_text")
    assert got == [
        (1, 1, 29, "Selected: 12 (1 page)"),
        (2, 10, 20, "Selected: 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 (10 pages)"),
        (3, 11, 19, "11 pages selected"),
        (4, 0, 30, "No pages selected"),
    ]


def test_span_forms_agree_with_row_forms(docs, table, small_blocks):
    texts = ["1-3,4,6", "1,2", "30,28-29,1-5,5-9", "7", "x", "1-30", "2,4,6,8,10,12,14,16,18,20,22"]
    requests = table("request_id bigint, doc_id bigint, custom_pages string", [(k, 6, t) for k, t in enumerate(texts)])
    selection, _ = sl.parse_page_spec(requests, docs, "crop")
    rows = sl.selected_pages(selection)
    assert tuples(sl.compact_spans(selection)) == tuples(sl.compact_selection(rows))
    assert tuples(sl.selection_summary(selection)) == tuples(sl.selected_summary(requests, docs, rows).rows)


def test_long_selections_fold_in_stretches(spark):
    """Spans of several stretches, overlapping across their borders, against plain Python."""
    from pagework.functions import sqltext as sq

    numbers = random.Random(4)
    spans = [(a, a + numbers.randrange(4)) for a in (numbers.randrange(1, 3000) for _ in range(900))]
    text = "array(" + ", ".join(f"named_struct('s', {a}, 'e', {b})" for a, b in spans) + ")"
    merged, joined = spark.sql(f"select {sq.merge('x')} as m, {sq.runs(sq.merge('x'))} as r from (select {text} as x)").first()
    pages = {p for a, b in spans for p in range(a, b + 1)}
    assert [p for x in merged for p in range(x.s, x.e + 1)] == sorted(pages)
    assert [p for x in joined for p in range(x.s, x.e + 1)] == sorted(pages)
    assert all(a.e + 1 < b.s for a, b in zip(joined, joined[1:]))


def test_hex_digits_beyond_any_page(docs, table):
    asked = table("request_id bigint, doc_id bigint, pages_text string, ranges_text string", [(1, 6, "0x00000000000000005,0xffffffffffffffffff", "0x00000000000000000002-0x3")])
    chosen, _ = sl.parse_page_spec(asked, docs, "form")
    assert [p for _, _, p in tuples(sl.selected_pages(chosen))] == [2, 3, 5]
