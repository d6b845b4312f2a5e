"""What the physical plans must not contain, and what the cheap ones must avoid."""

import re

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
PROJECTIONS = [
    "a1_scan_pdf_files", "a2_classify_security", "c3_split_every_n", "c4_extract_all", "c17_render_plan", "c14_watermark_ink",
    "d1_read_info", "d2_extract_tag", "d3_resolve_metadata", "d6_format_pdf_date", "d7_metadata_completeness",
    "e6_compression_outcome",
]


def plan(spark, key):
    return contract.queries()[key](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PROJECTIONS)
def test_projections_do_not_shuffle(spark, key):
    assert "Exchange" not in plan(spark, key)


def test_scans_read_only_what_they_need(spark):
    for key in ("c3_split_every_n", "c5_remove_pages", "b11_compact_spans", "c16_watermark_summary"):
        columns = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, key)))
        assert columns and all("text" not in c for c in columns)


def test_cap_cuts_before_the_shuffle(spark):
    text = plan(spark, "f2_cap_index")
    assert text.count("WindowGroupLimit") == 2


def test_request_work_joins_documents_once(spark):
    for key in ("b3_spec_crop", "c5_remove_pages", "c16_watermark_summary"):
        assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join ", plan(spark, key))) == 1


def numbered(spark, key, group):
    """Whether positions run 1..n without gap or repeat in every group of a manifest query."""
    rows = contract.queries()[key](spark, SF_DIR)
    counts = rows.groupBy(*group).agg({"out_no": "max", "*": "count"}).toDF(*group, "top", "n")
    distinct = rows.select(*group, "out_no").distinct().count()
    return counts.where("top <> n").count() == 0 and distinct == rows.count()


@pytest.mark.parametrize(
    "key, group",
    [
        ("c1_split_by_ranges", ["request_id", "part_no"]),
        ("c2_split_at_pages", ["request_id", "part_no"]),
        ("c3_split_every_n", ["doc_id", "part_no"]),
        ("c5_remove_pages", ["request_id"]),
        ("c6_organize_pages", ["request_id"]),
        ("c8_duplicate_pages", ["doc_id"]),
        ("c9_delete_pages", ["doc_id"]),
        ("c10_move_page", ["doc_id"]),
        ("c11_merge_docs", ["request_id"]),
    ],
)
def test_positions_have_no_gaps(spark, key, group):
    assert numbered(spark, key, group)


def test_rotations_are_quarter_turns(spark):
    for key in ("c6_organize_pages", "c7_rotate_pages"):
        turned = contract.queries()[key](spark, SF_DIR).select("rotation").distinct().collect()
        assert {r.rotation for r in turned} <= {0, 90, 180, 270}


@pytest.fixture
def as_for_large_tables(spark):
    """No side is small enough to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize(
    "key, most",
    [
        ("b9_invert_spans", 3), ("b9_invert_selection", 7), ("b12_selected_summary", 8), ("c8_duplicate_pages", 5), ("c9_delete_pages", 5),
        ("c12_number_pages", 4), ("e3_remove_images", 6), ("e5_dedupe_images", 3), ("f3_search_index", 6), ("f6_effective_opens", 9), ("f2_recent_index", 4),
    ],
)
def test_exchanges_of_large_tables(spark, as_for_large_tables, key, most):
    text = plan(spark, key)
    assert len(re.findall(r"Exchange (?:hash|range|Single)", text)) <= most
