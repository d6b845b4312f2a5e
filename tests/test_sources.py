import json

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.operators import manifest as mf
from pagework.operators.outcomes import from_result_json, results_of, to_result_json
from pagework.operators.validation import validate_requests
from pagework.plans.fixtures import Inputs
from pagework.sources import files, requests
from pagework.sources.manifest_sink import read_manifest, write_manifest

PLAIN = b"%PDF-1.4\n1 0 obj<<>>endobj\ntrailer<</Root 1 0 R>>\n%%EOF"
LOCKED = b"%PDF-1.4\ntrailer<</Root 1 0 R/Encrypt 2 0 R>>\n\xff\xfe%%EOF"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.pdf": PLAIN, "sub/B.PDF": LOCKED, "c.txt": PLAIN, "empty.pdf": b"", "d.pdf.bak": PLAIN}.items():
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def test_scan(spark, folder):
    scanned = files.scan_pdf_files(spark, folder)
    assert tuples(scanned, "file_name", "base", "file_size") == [("B.PDF", "B", len(LOCKED)), ("a.pdf", "a", len(PLAIN))]
    assert "content" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_security(spark, folder):
    classified = files.classify_security(files.read_pdf_bytes(spark, folder))
    found = {r.file_path.rsplit("/", 1)[1]: (r.is_encrypted, r.can_be_processed) for r in classified.collect()}
    assert found == {"a.pdf": (False, True), "B.PDF": (True, None)}


def read(spark, tmp_path, tool, *bodies):
    path = tmp_path / f"{tool}.json"
    path.write_text("\n".join(b if isinstance(b, str) else json.dumps(b) for b in bodies))
    return requests.read_requests(spark, str(path), tool).rows.collect()


def test_request_defaults(spark, tmp_path):
    (mark,) = read(spark, tmp_path, "watermark", {"request_id": 1, "opacity": 7})
    assert (mark.text, mark.position, mark.stamp_turn, mark.opacity, mark.mode) == ("CONFIDENTIAL", "Center", 45, 7, "all")
    (good,) = read(spark, tmp_path, "render", {"request_id": 1, "dpi": 300}, "{nonsense")
    assert (good.dpi, good.image_format, good.padded) == (300, "jpg", True)
    (order,) = read(spark, tmp_path, "organize", {"request_id": 1, "page_order": [{"page_number": 2}, {"page_number": 1, "rotation": 90}]})
    assert [tuple(x) for x in order.page_order] == [(2, 0), (1, 90)]
    (split,) = read(spark, tmp_path, "split", {"request_id": 1, "page_ranges": ["1-2"]})
    assert (split.method, split.output_format, split.page_ranges) == ("ByPageRanges", "Zip", ["1-2"])


def test_broken_requests_are_errors(spark, tmp_path):
    lines = ['{"request_id":1,"font_size":"big"}', "not json", "[1]", "", '{"request_id":2}', '{"request_id":3,"extra":1}']
    (tmp_path / "n.json").write_text("\n".join(lines))
    got = requests.read_requests(spark, str(tmp_path / "n.json"), "numbers")
    assert tuples(got.rows, "request_id", "font_size") == [(2, 12), (3, 12)]
    said = {e.errors[0]: e.request_id for e in got.errors.collect()}
    assert said == {requests.UNREADABLE + lines[0]: 1, requests.UNREADABLE + lines[1]: None, requests.UNREADABLE + lines[2]: None}


def test_files_too_large_to_read_are_errors(spark, folder):
    got = files.scan_security(spark, folder, largest=min(len(PLAIN), len(LOCKED)))
    assert got.rows.count() + got.errors.count() == 2 and got.errors.count() == 1


def test_names_that_look_like_numbers_stay_text(spark, table, tmp_path):
    manifest = table("doc_id bigint, output_name string, part_no int, out_no int, page_no int", [(1, "0012", 1, 1, 1), (1, "7", 1, 1, 2)])
    for by_output in (False, True):
        write_manifest(manifest, str(tmp_path / str(by_output)), by_output)
        assert tuples(read_manifest(spark, str(tmp_path / str(by_output))), "output_name", "page_no") == [("0012", 1), ("7", 2)]


@pytest.mark.parametrize("tool", requests.FIELDS)
def test_every_tool_has_a_schema(spark, tmp_path, tool):
    (row,) = read(spark, tmp_path, tool, {"request_id": 5})
    assert row.request_id == 5
    for name, value in requests.DEFAULTS.get(tool, {}).items():
        assert row[name] == value


@pytest.mark.parametrize("by_output", [True, False])
def test_manifest_round_trip(spark, pages, tmp_path, by_output):
    manifest = mf.split_every_n(pages, 5)
    write_manifest(manifest, str(tmp_path / "out"), by_output)
    back = read_manifest(spark, str(tmp_path / "out"))
    assert tuples(back, *manifest.columns) == tuples(manifest)
    directories = {p.name.split("=")[0] for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert directories == ({"output_name"} if by_output else set())


def test_results_never_lose_a_request(docs, table):
    asked = table("request_id bigint, doc_id bigint, page_ranges array<string>", [(1, 2, ["1"]), (2, 2, ["x", "9"]), (3, 77, ["1"])])
    outcome = mf.split_by_ranges(asked, docs)
    assert [tuple(r) for r in results_of(asked, outcome.errors).orderBy("request_id").collect()] == [
        (1, True, None),
        (2, False, "Invalid page number: 'x'; Page number 9 is out of range (1-3)"),
        (3, False, "File not found: 77"),
    ]


def test_passwords_do_not_leave(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    checked = validate_requests(inputs.tool_requests, inputs.docs, "lock")
    assert "password" not in checked.columns
    assert {r.tool for r in checked.select("tool").distinct().collect()} == {"lock"}


def test_result_json(table):
    lines = table(
        "request_id bigint, result string",
        [(1, '{"success":true}'), (2, '{"success":false,"error":"no"}'), (3, "oops"), (4, "{}"), (5, None)],
    )
    back = [tuple(r) for r in from_result_json(lines).orderBy("request_id").collect()]
    assert back == [(1, True, None), (2, False, "no"), (3, False, "Unknown error"), (4, False, "Unknown error"), (5, False, "Unknown error")]
    assert tuples(to_result_json(from_result_json(lines)), "result")[-1] == ('{"success":true,"error":null}',)


@pytest.fixture
def files_folder(spark, table, tmp_path):
    bodies = {
        "a/plain.pdf": b"%PDF-1.4 trailer<</Root 1 0 R>>", "a/locked.PDF": b"%PDF \xff\x00 /Encrypt 5 0 R", "b/locked.pDf": b"/Encrypt",
        "b/c/plain.Pdf": b"%PDF", "b/empty.pdf": b"", "b/note.txt": b"/Encrypt", "large.pdf": b"x" * 500, "large.PDF.txt": b"x",
    }
    rows = table("name string, content binary", [*bodies.items(), (None, b"x"), ("b/null.pdf", None)])
    folder = f"file://{tmp_path}/files-1"
    for _ in range(2):  # as if every task had to be run again
        written = files.write_files(rows.repartition(3), folder)
        assert tuples(written) == sorted([*((n, len(b)) for n, b in bodies.items()), ("b/null.pdf", 0)])
    assert not list((tmp_path / "files-1").rglob("*.part"))
    return folder


def test_written_files_are_scanned(spark, files_folder):
    found = files.scan_pdf_files(spark, files_folder)
    names = found.select(files.relative_path(F.col("file_path"), files_folder), "file_name", "base", "file_size")
    assert tuples(names) == [
        ("a/locked.PDF", "locked.PDF", "locked", 22), ("a/plain.pdf", "plain.pdf", "plain", 31), ("b/c/plain.Pdf", "plain.Pdf", "plain", 4),
        ("b/locked.pDf", "locked.pDf", "locked", 8), ("large.pdf", "large.pdf", "large", 500),
    ]
    assert files.scan_pdf_files(spark, files_folder, largest=30).count() == 3


def test_security_of_written_files(spark, files_folder):
    found = files.scan_security(spark, files_folder, largest=100)
    relative = lambda df, c: df.withColumn(c, files.relative_path(F.col(c), files_folder))
    assert tuples(relative(found.rows, "file_path")) == [
        ("a/locked.PDF", True, None), ("a/plain.pdf", False, True), ("b/c/plain.Pdf", False, True), ("b/locked.pDf", True, None),
    ]
    assert [r["errors"][0].rsplit("/", 1)[-1] for r in found.errors.collect()] == ["large.pdf"]


def test_the_reader_gets_the_limit_and_no_bytes_where_none_are_asked_for(spark, files_folder):
    plan = files.scan_security(spark, files_folder, largest=100).rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    plan = files.scan_pdf_files(spark, files_folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.mark.parametrize("folders", [1, 3, 40])
def test_dealt_files_are_listed_and_read_by_tasks(spark, table, tmp_path, monkeypatch, folders):
    """Reading by folders finds what Spark's reader finds, whose list the driver holds."""
    monkeypatch.setattr(files, "TOGETHER", 50)
    bodies = {f"a b/{'x' * (i % 3)}/{i}.{'pdf PDF Pdf txt pdf.bak'.split()[i % 5]}": (b"/Encrypt" * (i % 3)) + b"x" * (i % 7) for i in range(60)}
    bodies |= {"_hidden.pdf": b"x", ".h/a.pdf": b"x", "_k=1/a.pdf": b"xy", "_metadata.pdf": b"x", "5/7.pdf": b"x" * 90}
    root = f"file://{tmp_path}/files-2"
    rows = table("name string, content binary", [*bodies.items(), (None, b"x")])
    files.write_files(files.deal_files(rows, folders), root).write.format("noop").mode("overwrite").save()
    parts = files.dealt_folders(spark, root, folders)
    plain = lambda df, c="file_path": df.withColumn(c, files.dealt_name(F.col(c), root))
    found = files.list_pdf_files(files.read_folders(parts))
    assert tuples(plain(found)) == tuples(plain(files.scan_pdf_files(spark, root))) and found.count() > 30
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    ours, theirs = files.scan_security_of(parts, largest=16), files.scan_security(spark, root, largest=16)
    assert tuples(plain(ours.rows)) == tuples(plain(theirs.rows))
    end = lambda df: sorted(r["errors"][0].rsplit("files-2/", 1)[1] for r in df.collect())
    assert end(ours.errors) == end(theirs.errors) and ours.errors.count() > 3
    assert files.read_folders(parts, largest=16).where("(content is null) <> (length > 16) or octet_length(content) <> length").count() == 0


def test_files_of_any_size_are_searched_whole(spark, table, tmp_path, monkeypatch):
    """The query left out files above a limit; now none is, and a mark that lies across two pieces is found."""
    monkeypatch.setattr(files, "TOGETHER", 10)
    bodies = {f"{n}.pdf": b"x" * n + b"/Encrypt" + b"y" * (n % 7) for n in (*range(25), 9000)}
    bodies |= {"none.pdf": b"x" * 9000, "cut.pdf": b"/Encrypx" * 20 + b"/Encryp", "short.pdf": b"/E"}
    root = f"file://{tmp_path}/files-3"
    files.write_files(files.deal_files(table("name string, content binary", [*bodies.items()]), 3), root).write.format("noop").mode("overwrite").save()
    found = files.scan_security_of(files.dealt_folders(spark, root, 3))
    assert found.errors.count() == 0
    ours = tuples(found.rows.withColumn("file_path", files.dealt_name(F.col("file_path"), root)), "file_path", "is_encrypted")
    assert ours == sorted((name, b"/Encrypt" in body) for name, body in bodies.items())


def test_the_query_scans_every_file_it_wrote(spark):
    from pagework.plans.catalog import QUERIES

    sizes = {r["file_path"][1:]: r["file_size"] for r in QUERIES["a1_scan_written_files"](spark, "/root/testdata/sf0.001").collect()}
    assert max(sizes.values()) > 6000
    found = QUERIES["a2_scan_security"](spark, "/root/testdata/sf0.001")
    assert sorted(r["file_path"] for r in found.collect()) == sorted(sizes)


def test_folders_hold_a_bounded_number_of_files():
    assert [files.folders_for(n) for n in (0, 1, files.DEALT, files.DEALT + 1, 10 * files.DEALT)] == [1, 1, 1, 2, 10]


def test_documents_on_disk(spark, table, files_folder):
    scanned = files.scan_pdf_files(spark, files_folder).withColumn("file_path", files.relative_path(F.col("file_path"), files_folder))
    docs = table("doc_id bigint, file_path string, file_size bigint, page_count int", [(1, "a/plain.pdf", 9, 2), (2, "a/locked.pdf", 9, 2), (3, "b/empty.pdf", 9, 2), (4, None, 1, 1)])
    assert tuples(files.on_disk(docs, scanned), "doc_id", "file_size", "page_count") == [(1, 31, 2)]


def test_bucketed_manifests_join_without_a_shuffle(spark, table, tmp_path):
    from pagework.sources.manifest_sink import save_manifest

    rows = [(d, f"out{d % 7}", 1, o, o) for d in range(30) for o in range(1, 5)]
    manifest = table("doc_id bigint, output_name string, part_no int, out_no int, page_no int", rows)
    sizes = manifest.groupBy("output_name").agg(F.count("*").alias("n"))
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        save_manifest(manifest, "test_manifest", f"file://{tmp_path}/m", 4)
        save_manifest(sizes, "test_outputs", f"file://{tmp_path}/o", 4)
        joined = spark.table("test_manifest").join(spark.table("test_outputs"), "output_name")
        grouped = spark.table("test_manifest").groupBy("output_name").count()
        for df in (joined, grouped):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert tuples(joined, "doc_id", "output_name", "out_no", "n") == sorted((d, o, k, 20 if int(o[3:]) < 2 else 16) for d, o, _, k, _ in rows)
    finally:
        spark.conf.set(name, before)
        spark.sql("drop table if exists test_manifest")
        spark.sql("drop table if exists test_outputs")


def test_results_are_written_and_counted_in_one_pass(spark, table, tmp_path):
    from pagework.operators.outcomes import write_results

    looked = spark.sparkContext.accumulator(0)
    checked = table("request_id int, errors array<string>", [(1, []), (2, ["a", "b"]), (3, []), (4, [None])])

    def watch(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    counts = write_results(checked.mapInArrow(watch, checked.schema), str(tmp_path / "r"))
    assert counts == {"requests": 4, "succeeded": 2, "failed": 2} and looked.value == 4
    assert tuples(spark.read.parquet(str(tmp_path / "r")), "request_id", "success") == [(1, True), (2, False), (3, True), (4, False)]
    assert write_results(checked.limit(0), str(tmp_path / "e")) == {"requests": 0, "succeeded": 0, "failed": 0}
