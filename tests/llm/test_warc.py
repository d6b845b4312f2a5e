import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagework.llm import warc
from pagework.llm.common import run_folder

BIG = "é" * 700


@pytest.fixture
def pages(spark, long_text):
    rows = [
        (1, "http://b.example.com/x?y=1", BIG, "k"), (2, "http://a.example.com/", BIG, None), (3, None, BIG, "k"),
        (4, "no url", "short", "k"), (5, "http://b.example.com/x?y=1", "short", "k"), (6, "http://h/\r\nx", None, "k"),
        (7, "http://a.example.com/", long_text, "k"), (8, "", "", "k"), (8, "", "", "k"), (None, "http://a.example.com/", BIG, "k"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, archive string")


def stored(spark, pages, block=3):
    folder = run_folder(spark, "warc-test")
    captures = warc.write_archives(pages, folder, "page_id", "url", "html")
    return folder, captures, warc.build_index(captures, folder, block)


def test_read_back(spark, pages):
    folder, captures, index = stored(spark, pages)
    found = warc.lookup(index, folder, pages.select(warc.url_key("url").alias("capture")))
    assert found.count() == captures.count() == 10
    got = {r["id"]: r for r in warc.read_captures(found, folder).collect()}
    for r in pages.collect():
        payload = (r["html"] or "").encode()
        row = got[r["page_id"]]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        twin = r["html"] == BIG and r["page_id"] != 3
        assert (row["record_type"], row["refers_to"]) == (("revisit", 3) if twin else ("response", None))
        assert row["payload"] is None if twin else bytes(row["payload"]) == payload
    assert got[6]["url"] == "http://h/%0D%0Ax" and got[3]["url"] is None


def test_keys(spark, pages):
    folder, _, index = stored(spark, pages)

    def ids(*keys):
        asked = spark.createDataFrame([(k,) for k in keys], "capture string")
        return sorted(str(r["id"]) for r in warc.lookup(index, folder, asked).collect())

    assert ids("com,example,a)/") == ["2", "7", "None"]
    assert ids("com,example,b)/x?y=1", "com,example,b)/x?y=1", None) == ["1", "5"]
    assert ids("", "zz", "com,example,aa)/") == ["3", "8", "8"]


@pytest.fixture
def many_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_a_hot_key_goes_on_over_blocks_and_files(spark, many_tasks):
    pages = spark.range(3000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.org/', concat('http://s', id, '.net/')) as url", "'p' as html")
    folder, _, index = stored(spark, pages.repartition(6), block=50)
    asked = spark.createDataFrame([("org,hot)/",)], "capture string")
    found = warc.lookup(index, folder, asked)
    assert found.count() == 1000 and index.count() > 1
    assert warc.read_captures(found, folder).selectExpr("count(distinct id)").first()[0] == 1000


def test_archives_are_gzip_members(spark, pages):
    folder, captures, _ = stored(spark, pages)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file:")).glob("*.warc.gz"))
    assert text.count(b"WARC-Type: response") == 7 and text.count(b"WARC-Type: revisit") == 3


def test_a_damaged_record_is_found():
    data = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder, captures, index = stored(spark, pages)
    found = warc.lookup(index, folder, pages.select(warc.url_key("url").alias("capture")))
    assert (captures.count(), index.count(), warc.read_captures(found, folder).count()) == (0, 0, 0)


def test_tasks_of_reading_follow_the_bytes(spark, monkeypatch):
    """With adaptive execution on: the shuffle holds places only, and is small."""
    df = spark.range(400).selectExpr("id as page_id", "concat('http://h', id, '.org/') as url", "repeat(uuid(), 200) as html").repartition(8)
    folder = run_folder(spark, "warc")
    captures = warc.write_archives(df, folder, "page_id", "url", "html")
    total = captures.groupBy().sum("length").first()[0]
    monkeypatch.setattr(warc, "CHUNK_BYTES", total // 40)
    for tasks in (1, 6, 12):
        monkeypatch.setattr(warc, "TASK_BYTES", -(-total // tasks))
        found = warc.read_captures(captures, folder)
        assert found.count() == 400 and found.rdd.getNumPartitions() == tasks
        if tasks > 1:
            assert found.select(F.spark_partition_id().alias("p")).distinct().count() > tasks // 2
