import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.operators import images as im
from pagework.operators import selection as sl

IMAGE = (
    "doc_id bigint, page_no int, img_index int, xref bigint, width bigint, height bigint, n_components int, has_alpha boolean"
)


@pytest.fixture
def images(table):
    return table(
        IMAGE,
        [
            (2, 1, 0, 7, 10, 10, 4, False),
            (2, 1, 1, 8, 10, 10, 4, True),
            (2, 2, 0, 7, 10, 10, 4, False),
            (2, 3, 0, 9, 10, 10, 3, False),
            (3, 1, 0, 7, 10, 10, 1, False),
        ],
    )


@pytest.fixture
def selection(table, docs):
    requests = table(
        "request_id bigint, doc_id bigint, pages array<int>, page_ranges array<string>",
        [(1, 2, [1], None), (2, 2, None, None), (3, 4, [1, 2], None)],
    )
    return sl.parse_page_spec(requests, docs, "images")[0]


def test_extract(selection, images):
    rows = tuples(im.extractable_images(selection, images), "request_id", "page_no", "img_index", "image_name")
    assert rows == [
        (1, 1, 1, "page_1_image_0001.png"),
        (2, 1, 1, "page_1_image_0001.png"),
        (2, 3, 0, "page_3_image_0000.png"),
    ]
    as_jpg = im.extractable_images(selection, images, F.lit("JPG")).where("request_id = 1")
    assert tuples(as_jpg, "image_name") == [("page_1_image_0001.jpg",)]
    assert tuples(im.extraction_summary(selection, images)) == [(1, 2, 1, 1), (2, 2, 2, 3), (3, 4, 0, 2)]


def test_removing_an_object_takes_it_from_every_page(selection, images):
    left = im.remove_images(selection, images)
    assert tuples(left, "request_id", "page_no", "xref") == [(1, 3, 9)]


@pytest.mark.parametrize(
    "width, height, quality, plan",
    [
        (30, 33, 5, ("keep", 30, 33, None)),
        (40, 25, 5, ("recompress", 32, 20, 5)),
        (401, 300, 10, ("recompress", 400, 299, 5)),
        (600, 600, 30, ("recompress", 480, 480, 10)),
        (601, 1, 30, ("keep", 601, 1, None)),
        (1200, 900, 50, ("recompress", 800, 600, 20)),
        (2048, 1000, 51, ("recompress", 1024, 500, 51)),
        (2048, 1000, 90, ("recompress", 1024, 500, 90)),
        (1001, 1, 90, ("keep", 1001, 1, None)),
    ],
)
def test_recompress(table, width, height, quality, plan):
    rows = im.recompress_plan(table(IMAGE, [(1, 1, 0, 1, width, height, 3, False)]), F.lit(quality))
    assert tuples(rows, "action", "new_width", "new_height", "jpeg_quality") == [plan]


def test_presets(spark):
    presets = [("Low", None, 50), ("Medium", 1, 75), ("High", None, 90), ("Custom", 12, 12), ("Custom", None, 75), ("?", 3, 75)]
    df = spark.createDataFrame(presets, "preset string, custom int, want int")
    assert df.where(im.preset_quality(F.col("preset"), F.col("custom")) != F.col("want")).count() == 0


def test_dedupe_against_brute_force(table, small_blocks):
    rng = random.Random(3)
    rows = [
        (d, page, k, 1, rng.choice([10, 20]), rng.choice([5, 6]), 3, False)
        for d in (1, 2) for page in range(1, 40) for k in range(rng.randint(0, 3))
    ]
    rng.shuffle(rows)
    plan = table(IMAGE, rows).withColumnsRenamed({"width": "new_width", "height": "new_height"})
    seen, want = set(), []
    for d, page, k, _, w, h, *_ in sorted(rows):
        want.append((d, page, k, (d, w, h) in seen))
        seen.add((d, w, h))
    assert tuples(im.dedupe_images_by_dims(plan), "doc_id", "page_no", "img_index", "is_duplicate") == want


@pytest.mark.parametrize(
    "original, compressed, want",
    [
        (1000, 400, (False, 400, 60.0)),
        (1000, 1000, (True, 1000, 0.0)),
        (1000, 1200, (True, 1000, 0.0)),
        (0, 0, (True, 0, 0.0)),
        (3, 2, (False, 2, 33.33)),
        (800, 799, (False, 799, 0.12)),
    ],
)
def test_outcome(table, original, compressed, want):
    rows = im.compression_outcome(table("original_size bigint, compressed_size bigint", [(original, compressed)]))
    assert tuples(rows, "kept_original", "final_size", "compression_ratio") == [want]
