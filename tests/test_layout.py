import math
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.functions import numbers as nu
from pagework.operators import layout as la


def one(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize(
    "number, text",
    [(0, "0"), (1, "I"), (4, "IV"), (9, "IX"), (44, "XLIV"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX"), (4000, "4000"), (-3, "-3")],
)
def test_roman(spark, number, text):
    assert one(spark, nu.roman(F.lit(number))) == text


@pytest.mark.parametrize(
    "size, text",
    [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (10 * 1024**2, "10 MB"),
     (1024**3, "1 GB"), (1024**4, "1 TB")],
)
def test_human_size(spark, size, text):
    assert one(spark, nu.human_size(F.lit(size))) == text


def test_small_expressions(spark):
    assert [one(spark, nu.quarter_turn(F.lit(d))) for d in (-90, 450, 360)] == [270, 90, 0]
    assert [one(spark, nu.colour_channel(F.lit("#0A10ff"), i)) for i in range(3)] == [10, 16, 255]
    assert [one(spark, nu.colour_channel(F.lit("red"), i)) for i in range(3)] == [52, 152, 219]
    assert one(spark, nu.megabytes(F.lit(1572864))) == "1.50"


def test_megabytes_round_ties_to_even(spark):
    numbers = random.Random(3)
    sizes = [6400000000000, 6659328000000000, 131072, 393216, 655360, 5242, 5243, 1048575, 1043334, 0, -1, -131072, 2**63 - 1]
    sizes += [numbers.randrange(2 ** numbers.randrange(1, 63)) for _ in range(300)] + [numbers.randrange(1 << 36) << 17 for _ in range(100)]
    found = spark.createDataFrame([(n,) for n in [*sizes, None]], "n bigint").select("n", nu.megabytes(F.col("n"))).collect()
    assert all(text == (None if n is None else "%.2f" % (n / 1048576)) for n, text in found)


@pytest.mark.parametrize("turn", [0, 45, 90, -30, 180, 270, 405])
def test_turned_box(spark, turn):
    w, h = 331, 57
    wide, tall = (one(spark, c) for c in nu.turned_box(F.lit(w), F.lit(h), F.lit(turn)))
    if turn % 180 == 0:
        assert (wide, tall) == (w, h)
    elif turn % 90 == 0:
        assert (wide, tall) == (h, w)
    else:
        a = math.radians(turn)
        reach = abs(w * math.cos(a)) + abs(h * math.sin(a))
        assert reach - 1e-9 <= wide <= reach + 2


def test_labels_and_anchor(docs, pages, table):
    requests = table(
        "request_id bigint, doc_id bigint, position string, format string, font_size int, start_page int, start_number int",
        [(1, 2, "TopLeft", "PageOfTotal", 10, 2, 5), (2, 2, "BottomRight", "RomanLower", 12, 1, 4), (3, 1, "?", "?", 8, 1, 7)],
    )
    got = tuples(la.number_pages(requests, docs, pages).rows, "request_id", "page_no", "label", "x", "y")
    assert got == [
        (1, 2, "Page 5 of 3", 20.0, 30.0),
        (1, 3, "Page 6 of 3", 20.0, 30.0),
        (2, 1, "iv", 612 - 12.0 - 20, 772.0),
        (2, 2, "v", 612 - 6.0 - 20, 772.0),
        (2, 3, "vi", 612 - 12.0 - 20, 772.0),
        (3, 1, "7", (612 - 4.0) / 2, 772.0),
    ]
    sizes = table("text string, font_size int, width double, height double", [("v", 12, 100.0, 3.0)])
    measured = la.number_pages(requests, docs, pages, text_metrics=sizes).rows
    assert tuples(measured.where("request_id = 2"), "label", "x") == [("iv", 580.0), ("v", 492.0), ("vi", 580.0)]


def test_turned_pages_swap_sides(docs, pages, table):
    requests = table(
        "request_id bigint, doc_id bigint, position string, format string, font_size int, start_page int, start_number int",
        [(1, 1, "BottomLeft", "Number", 10, 1, 1)],
    )
    sideways = pages.withColumn("rotation", F.lit(90))
    assert tuples(la.number_pages(requests, docs, sideways).rows, "x", "y") == [(20.0, 592.0)]
    assert tuples(la.render_plan(sideways.where("doc_id = 1"), 144, "png", False), "image_name", "pixel_width", "pixel_height") == [
        ("d1_1.png", 1584, 1224)
    ]


def test_crop(docs, pages, table, small_blocks):
    requests = table(
        "request_id bigint, doc_id bigint, pages_range string, custom_pages string, m_top double, m_right double,"
        " m_bottom double, m_left double",
        [
            (1, 3, "custom", "3-2,9", 10.0, 20.0, 30.0, 40.0),
            (2, 3, "all", None, 400.0, 0.0, 392.0, 0.0),
            (3, 3, "current", None, 1.0, 1.0, 1.0, 1.0),
            (4, 3, "current", "1", 1.0, 1.0, 1.0, 1.0),
        ],
    )
    rows = la.crop_pages(requests, docs, pages).rows
    assert tuples(la.crop_summary(rows)) == [(1, 3, 9, 3), (2, 3, 9, 0), (3, 3, 9, 0), (4, 3, 9, 1)]
    boxes = tuples(rows.where("request_id = 1 and is_cropped"), "page_no", "crop_x1", "crop_y1", "crop_x2", "crop_y2")
    assert boxes == [(p, 40.0, 30.0, 592.0, 782.0) for p in (2, 3, 9)]


STAMP = (
    "request_id bigint, doc_id bigint, mode string, custom_pages string, start_page int, end_page int, watermark_type string,"
    " text string, position string, stamp_turn int, font_size int, image_width int, image_height int, image_scale int"
)


def test_watermark(docs, pages, table, small_blocks):
    requests = table(
        STAMP,
        [
            (1, 2, "last", "", 1, 0, "text", "AB", "TopRight", 0, 36, None, None, None),
            (2, 3, "custom", "2,8-99", 1, 0, "image", "", "Tiled", 90, 36, 100, 40, 50),
        ],
    )
    # Two letters at 36 pt: 2 * 36 * 300/72 = 300 px and 150 px high, plus 120 px of padding on each side.
    w, h = 540 * 72 / 300, 390 * 72 / 300
    (placed,) = tuples(la.place_watermark(requests, docs, pages).rows, "page_no", "left", "top", "right", "bottom")
    assert placed == pytest.approx((3, 612 - w - 30.6, 39.6, 612 - 30.6, 39.6 + h))
    tiles = tuples(la.place_tiled(requests, docs, pages).rows, "page_no", "tile_no", "left", "top", "right", "bottom")
    assert [t[0] for t in tiles] == [2, 2, 2, 8, 8, 8, 9, 9, 9]
    for _, tile, left, top, right, bottom in tiles:
        assert (right - left, bottom - top) == (20.0, 50.0)
        assert (left + right) / 2 == 306.0
        assert (top + bottom) / 2 == pytest.approx(792 / 2 * {1: 1, 2: 1 / 3, 3: 5 / 3}[tile])
    assert tuples(la.watermark_summary(requests, docs).rows) == [(1, 2, 3, 1), (2, 3, 9, 3)]


def test_picture_names(pages):
    rows = tuples(la.render_plan(pages.where("doc_id = 4 and page_no > 9"), 150, "jpg"), "image_name", "pixel_width", "pixel_height")
    assert rows[0] == ("d4_page_010.jpg", 1275, 1650)


def test_texts_are_measured_by_glyphs(table):
    glyphs = table("glyph string, advance int", [("a", 400), ("b", 650), (" ", 250), ("𝄞", 900)])
    texts = table("text string, font_size int", [("ab a", 10), ("ab a", 20), ("ab a", 20), ("a?", 10), ("𝄞", 10), ("", 10), (None, 10), ("b", None)])
    found = la.measure_texts(texts, glyphs)
    assert tuples(found) == [("", 10, 0.0, 10.0), ("a?", 10, 9.0, 10.0), ("ab a", 10, 17.0, 10.0), ("ab a", 20, 34.0, 20.0), ("𝄞", 10, 9.0, 10.0)]
    assert tuples(la.measure_texts(texts, glyphs.limit(0)), "text", "width")[1] == ("a?", 10.0)


def test_labels_take_the_glyphs_widths(table, docs, pages):
    requests = table(
        "request_id int, doc_id bigint, position string, format string, font_size int, start_page int, start_number int",
        [(1, 4, "BottomRight", "Number", 10, 1, 8)],
    )
    glyphs = table("glyph string, advance int", [("8", 300), ("9", 700), ("1", 100)])
    found = dict(tuples(la.number_pages(requests, docs, pages, glyphs=glyphs).rows, "label", "x"))
    assert (found["8"], found["9"], found["11"]) == (612 - 3 - 20, 612 - 7 - 20, 612 - 2 - 20)
    assert found["12"] == 612 - 6 - 20  # half an em for the unknown 2
