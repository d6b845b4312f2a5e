import datetime

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.operators import metadata as md


def one(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize(
    "packet, value",
    [
        ("<dc:title>A</dc:title>", "A"),
        ("<dc:titleX y='1'> A <b>c</b>\n</dc:title>", "A <b>c</b>"),
        ("<dc:title><![CDATA[ x ]]></dc:title>", " x "),
        ("<dc:title><![CDATA[  ]]></dc:title>", None),
        ("<dc:title>\u00a0 </dc:title>", None),
        ("<dc:title>open", None),
        ("<dc:title/>", None),
        ("<a>no</a>", None),
        ("<dc:title>1</dc:title><dc:title>2</dc:title>", "1"),
        (None, None),
    ],
)
def test_tag_text(spark, packet, value):
    assert one(spark, md.tag_text(F.lit(packet).cast("string"), "dc:title")) == value


@pytest.mark.parametrize(
    "text, shown",
    [
        ("D:20240131123059+02'00'", "2024-01-31 12:30:59"),
        ("D:202401", "2024-01- ::"),
        ("2024", "2024"),
        ("", "Not set"),
        (None, "Not set"),
    ],
)
def test_dates(spark, text, shown):
    assert one(spark, md.format_pdf_date(F.lit(text).cast("string"))) == shown


def test_typed_date(spark):
    assert one(spark, md.pdf_timestamp(F.lit("D:20240131123059Z"))) == datetime.datetime(2024, 1, 31, 12, 30, 59)
    assert one(spark, md.pdf_timestamp(F.lit("D:20241331123059Z"))) is None
    assert one(spark, md.pdf_timestamp(F.lit("D:2024"))) is None


@pytest.fixture
def documents(table):
    xmp = "<dc:title>T</dc:title><dc:creator>Ann</dc:creator>"
    return table(
        "doc_id bigint, info map<string,string>, xmp string, page_count int",
        [
            (1, {"Title": " a ", "Author": " ", "CreationDate": "D:1", "Odd": "o"}, xmp, 1),
            (2, {"Title": "\t", "Authors": "B"}, xmp, 2),
            (3, {"Authors": "B", "PDFProducer": "P", "ModDate": "x"}, None, 3),
            (4, {}, "<x/>", 4),
        ],
    )


def test_fallback_is_for_the_whole_document(documents):
    fields = ("doc_id", "title", "author", "producer", "creation_date", "modification_date")
    got = [tuple(r) for r in md.resolve_metadata(documents).select(*fields).orderBy("doc_id").collect()]
    assert got == [
        (1, "a", None, None, "D:1", None),
        (2, "T", "Ann", None, None, None),
        (3, None, "B", "P", None, "x"),
        (4, None, None, None, None, None),
    ]
    complete = md.metadata_completeness(md.resolve_metadata(documents))
    assert tuples(complete) == [
        (1, ["author"], False), (2, [], True), (3, ["title"], False), (4, ["title", "author"], False),
    ]


def test_edits_delete_what_is_blank(documents, table):
    edits = table(
        "doc_id bigint, metadata struct<title:string,author:string,subject:string,keywords:string,creator:string,"
        "producer:string>",
        [(1, (" new ", "", None, None, None, None)), (2, None)],
    )
    out = md.apply_metadata_edits(documents, edits)
    infos = {r.doc_id: r.info for r in out.rows.collect()}
    assert infos[1] == {"Title": " new ", "CreationDate": "D:1", "Odd": "o"}
    assert infos[2] == {"Title": "\t", "Authors": "B"}
    assert infos[4] == {}
    assert tuples(out.errors, "doc_id", "errors") == [(2, ["Metadata is required for write operation"])]


def test_strip(documents):
    kept = {r.doc_id: (r.info, r.xmp) for r in md.strip_metadata(documents, F.col("doc_id") < 3).collect()}
    assert kept[1] == ({}, None) and kept[2] == ({}, None)
    assert kept[3][0]["Authors"] == "B" and kept[4] == ({}, "<x/>")


def test_a_rewrite_leaves_untouched_buckets_alone(spark, table, tmp_path):
    folder = str(tmp_path / "documents")
    docs = table("doc_id bigint, info map<string,string>, xmp string", [(i, {"Title": f"t{i}", "CreationDate": "D:2024"}, None) for i in range(60)])
    md.write_documents(docs, folder, buckets=8)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "documents").rglob("*.parquet")}
    before = files()
    fields = ", ".join(f"{f}: string" for f in md.GATED)
    full = dict.fromkeys(md.GATED, None) | {"title": "New"}
    edits = table(f"doc_id bigint, metadata struct<{fields}>", [(7, tuple(full.values())), (999, tuple(full.values()))])
    for _ in range(2):
        errors = md.rewrite_metadata(edits, folder, docs.schema, buckets=8)
        assert [r["doc_id"] for r in errors.collect()] == [999]
    rows = {r["doc_id"]: r["info"] for r in md.read_documents(spark, folder, docs.schema).collect()}
    assert len(rows) == 60 and rows[7] == {"Title": "New", "CreationDate": "D:2024"} and rows[8] == {"Title": "t8", "CreationDate": "D:2024"}
    after = files()
    touched = {r[0] for r in edits.select(md._bucket(8)).collect()}
    for path, changed in before.items():
        if int(path.parent.name.removeprefix("bucket=")) in touched:
            assert path not in after
        else:
            assert after[path] == changed
    assert len(touched) < len({p.parent for p in before})
