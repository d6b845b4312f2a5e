"""WARC archives with a two-level capture index.

Writing: each task writes gzip members, one a record, to archives of its own in a shared folder, and returns one capture row
a record. A payload that another record holds already becomes a revisit. Only the rows of tasks that ended count, so files of
lost or repeated tasks are never read.

Index: capture rows are range-sorted by reversed-host URL key. Each task writes one index file: compressed blocks of sorted
lines, then a sparse directory with the first and last key of each block, then the directory's length. The table of index
files, one row a task, holds their key ranges.

Lookup: the key range of the files is searched by bisection, then the directory of a file, then the block; only that block is
read. The captures found are ordered by place, and neighbours in an archive are read as one range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import place, slices, written

# The format's names, and the length from which equal payloads are stored once.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 1000

BLOCK_LINES = 1024
ARCHIVE_BYTES = 1 << 30  # a task begins another archive from here
RANGE_BYTES, RANGE_GAP = 8 << 20, 64 << 10  # the most read at once, and the gap that is read over
CHUNK_BYTES = 1 << 20  # stretch of an archive whose captures one group of reads takes
TASK_BYTES = 16 << 20  # of compressed records that a task reads back, on average

CAPTURE = "capture string, id bigint, archive string, offset bigint, length bigint"
RECORD = "id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def url_key(url: str) -> Column:
    """Reversed host labels, then what follows the host; an empty key for null. Texts without "://" are their own key."""
    parts = F.regexp_extract(F.col(url), r"^[^:/?#]*://([^/?#]*)", 1)
    host = F.concat_ws(",", F.reverse(F.split(F.lower(parts), r"\.")))
    rest = F.regexp_extract(F.col(url), r"(?s)^[^:/?#]*://[^/?#]*(.*)$", 1)
    key = F.when(F.contains(F.col(url), F.lit("://")), F.concat(host, F.lit(")"), rest)).otherwise(F.col(url))
    return F.coalesce(key, F.lit(""))


def with_revisits(df: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """Columns id, url, capture, payload, digest, refers_to. ``refers_to`` is the largest id among equal payloads of at least
    ``REVISIT_BYTES``, and null for the record that has it and for shorter payloads. A null id never is the response where
    another has an id. Rows that repeat the response are responses too."""
    base = df.select(
        F.col(page_id).cast("bigint").alias("id"),
        F.col(url).cast("string").alias("url"),
        url_key(url).alias("capture"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    twin = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)).alias("twin")
    held = (
        base.select("id", twin)
        .filter("twin is not null")
        .groupBy("twin")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    long = F.octet_length("payload") >= REVISIT_BYTES  # short ones have no twin, and would meet at one key in the join
    joined = base.filter(long).withColumn("twin", twin).join(held, "twin", "left")
    named = ["id", "url", "capture", "payload", "digest"]
    revisits = joined.select(*named, F.when(~F.expr("id <=> top"), F.col("top")).alias("refers_to"))
    return revisits.union(base.filter(~long).select(*named, F.lit(None).cast("bigint").alias("refers_to")))


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """Header lines; line breaks inside a value are percent-encoded."""
    lines = [VERSION] + [f"{k}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in fields if v is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _digest_field(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:capture:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:capture:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response or revisit record. A revisit has the HTTP header, with the length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", _digest_field(digest)),
        ("WARC-Refers-To", None if refers_to is None else _urn(refers_to)),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields from its bytes; digest and length of a payload are worked out where the record has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = stored if revisit else hashlib.sha1(payload).hexdigest()
    if not revisit and (digest, len(payload)) != (stored, length):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "id": _page_id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page_id(fields.get("WARC-Refers-To")) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": None if revisit else payload,
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(df: DataFrame, folder: str, page_id: str, url: str, payload: str) -> DataFrame:
    """Writes a record for each row and returns the captures, one a row, as a written table.

    Null payloads are empty, null URLs have no target field and the empty key. An empty table writes nothing."""

    def run(batches):
        store, path = place(folder)
        archive, out, at = "", None, 0
        for batch in slices(batches):
            found = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    archive = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{archive}", compression=None)
                    at = out.write(_gzip(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Length", "0")]) + b"\r\n\r\n"))
                member = _gzip(record(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                out.write(member)
                found.append((row["capture"], row["id"], archive, at, len(member)))
                at += len(member)
            yield _batch(found, CAPTURE)
        if out is not None:
            out.close()

    store, path = place(folder)
    store.create_dir(path, recursive=True)
    return written(with_revisits(df, page_id, url, payload).mapInArrow(run, CAPTURE), "captures")


ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def build_index(captures: DataFrame, folder: str, block: int = BLOCK_LINES) -> DataFrame:
    """Writes the index files and returns their table: index, first, last, captures. One row a task, sorted files whose key
    ranges may share a border key."""
    schema = "index string, first string, last string, captures bigint"

    def run(batches):
        name, out, at, lines, directory, total = f"{uuid.uuid4().hex}.idx", None, 0, [], [], 0
        store, path = place(folder)

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            packed = zlib.compress(json.dumps(lines).encode())
            out.write(packed)
            directory.append((lines[0][0], lines[-1][0], at, len(packed)))
            at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                total += 1
                if len(lines) >= block:
                    flush()
        if lines:
            flush()
        if out is not None:
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed + len(packed).to_bytes(8, "big"))
            out.close()
            yield _batch([(name, directory[0][0], directory[-1][1], total)], schema)

    store, path = place(folder)
    store.create_dir(path, recursive=True)
    ordered = captures.select("capture", "id", "archive", "offset", "length")
    ordered = ordered.repartitionByRange("capture", "archive", "offset").sortWithinPartitions("capture", "archive", "offset")
    return written(ordered.mapInArrow(run, schema), "index-files")


class IndexFile:
    """One index file: its directory in memory, blocks read when asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        length = int.from_bytes(file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(file.read_at(length, size - 8 - length)))
        self.lasts = [d[1] for d in self.directory]
        self.kept = (-1, [])

    def block(self, i: int) -> list[list]:
        if self.kept[0] != i:
            self.kept = (i, json.loads(zlib.decompress(self.file.read_at(self.directory[i][3], self.directory[i][2]))))
        return self.kept[1]

    def find(self, key: str):
        """Captures of a key, which may go on over several blocks."""
        i = bisect_left(self.lasts, key)
        while i < len(self.directory) and self.directory[i][0] <= key:
            lines = self.block(i)
            yield from lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]
            i += 1


def lookup(index: DataFrame, folder: str, keys: DataFrame, key: str = "capture") -> DataFrame:
    """The captures of each distinct key of ``keys``; keys without a capture, and null, give none.

    The table of index files has one row a task that wrote one, so its ranges go to each task."""
    files = sorted((r["last"], r["first"], r["index"]) for r in index.collect())
    lasts = [last for last, _, _ in files]

    def route(batches):
        for batch in batches:
            found = []
            for k in batch.column(0).to_pylist():
                i = bisect_left(lasts, k)
                while i < len(files) and files[i][1] <= k:
                    found.append((files[i][2], k))
                    i += 1
            yield _batch(found, "index string, key string")

    def search(batches):
        store, path = place(folder)
        name, index_file = "", None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part, found = batch.slice(start, 1024), []
                for index_name, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if index_name != name:
                        name, index_file = index_name, IndexFile(store.open_input_file(f"{path}/{index_name}"))
                    for line in index_file.find(k):
                        found.append(tuple(line))
                        if len(found) >= 8192:
                            yield _batch(found, CAPTURE)
                            found = []
                yield _batch(found, CAPTURE)

    wanted = keys.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    routed = wanted.mapInArrow(route, "index string, key string")
    dealt = routed.repartition("index", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("index", "key")
    return dealt.mapInArrow(search, CAPTURE)


def read_captures(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The record of each capture. Captures are dealt by stretch of archive and read in order of place. Without ``payloads``
    the payload column is null; digest and length are still those of the payload that was read."""

    def run(batches):
        store, path = place(folder)
        name, file = "", None
        for batch in slices(batches, 1024):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            start = 0
            while start < len(rows):
                archive, low, high = rows[start][0], rows[start][1], rows[start][1] + rows[start][2]
                end = start + 1
                while end < len(rows) and rows[end][0] == archive and rows[end][1] <= high + RANGE_GAP and rows[end][1] + rows[end][2] - low <= RANGE_BYTES:
                    high = max(high, rows[end][1] + rows[end][2])
                    end += 1
                if archive != name:
                    name, file = archive, store.open_input_file(f"{path}/{archive}")
                data = memoryview(file.read_at(high - low, low))
                found = [parse(zlib.decompress(data[at - low : at - low + n], 31)) for _, at, n in rows[start:end]]
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield _batch([tuple(x.values()) for x in found], RECORD)
                start = end

    placed = written(captures.select("archive", "offset", "length"), "captures")
    # The shuffle holds places only, so its size says nothing of the bytes that are read: tasks are counted by these.
    tasks = max(1, math.ceil((placed.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES))
    ordered = placed.withColumn("stretch", F.expr(f"offset div {CHUNK_BYTES}"))
    ordered = ordered.repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    return ordered.mapInArrow(run, RECORD)
