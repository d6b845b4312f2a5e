"""PDF files as rows."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.functions import text as tx
from pagework.operators.rows import Outcome

# The most bytes one row can hold.
LARGEST = 2**31 - 1 - 16
# Files that are dealt to one folder on average, and bytes of files that a task holds at once (one file at least).
DEALT, TOGETHER = 4096, 4 << 20
# What names an encryption dictionary.
ENCRYPT = b"/Encrypt"


def read_pdf_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all PDF files below ``folder``; empty files do not appear."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def relative_path(path: Column, folder: str) -> Column:
    """What comes after ``folder`` in ``path``; the reader may write the folder's scheme in another way."""
    return F.regexp_replace(path, "^.*" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", "")


def _places():
    """A function that tells file system and path of a folder, given as a URI or a path; it travels with the tasks that use it."""

    def place(target: str):
        if target.startswith("file:"):
            return fs.LocalFileSystem(), "/" + target[5:].lstrip("/")
        return fs.FileSystem.from_uri(target)

    return place


def deal_files(rows: DataFrame, folders: int) -> DataFrame:
    """``rows`` whose ``name`` lies in one of so many numbered folders, by its hash. Each can be written to and listed on its own,
    however many files the names' own folders hold."""
    number = F.pmod(F.hash("name"), F.lit(folders))
    return rows.withColumn("name", F.concat(number.cast("string"), F.lit("/"), "name"))


def folders_for(files: int) -> int:
    """How many folders so many files are dealt over."""
    return max(1, -(-files // DEALT))


def dealt_folders(spark: SparkSession, folder: str, folders: int) -> DataFrame:
    """The numbered folders below ``folder``, each to be listed by a task."""
    return spark.range(0, folders, 1, folders).select(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("id").cast("string")).alias("folder"))


def dealt_name(path: Column, folder: str) -> Column:
    """The name that a file had before it was dealt to a folder below ``folder``."""
    return F.regexp_replace(relative_path(path, folder), "^[0-9]+/", "")


def _lister():
    """A function that tells path below ``root`` and entry of each PDF file there, of any depth, without empty and hidden ones; it
    travels with the tasks that use it."""

    def hidden(part):
        return part.startswith(".") or part.startswith("_") and "=" not in part

    def listed(store, root):
        for file in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            below = file.path[len(root.rstrip("/")) :]
            if file.type == fs.FileType.File and file.size and below.lower().endswith(".pdf") and not any(map(hidden, below[1:].split("/"))):
                yield below, file

    return listed


def read_folders(folders: DataFrame, largest: int = -1) -> DataFrame:
    """``path, length, content`` of all PDF files below each ``folder``, of any depth; ``content`` is null for files larger than
    ``largest``, which are not opened.

    A task lists its own folders and no list reaches the driver. As the reader of ``read_pdf_bytes`` does, it passes over empty
    files, hidden ones (a leading dot or underscore) and hidden folders. A folder that isn't there has no files."""
    place, listed = _places(), _lister()

    def run(batches):
        def out():
            columns = [pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "length", "content"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, root = place(folder)
                paths, lengths, contents, held = [], [], [], 0
                for below, file in listed(store, root):
                    wanted = file.size <= largest
                    if paths and held + wanted * file.size > TOGETHER:
                        yield out()
                        paths, lengths, contents, held = [], [], [], 0
                    content = None
                    if wanted:
                        with store.open_input_file(file.path) as source:
                            content = source.read()
                        held += file.size
                    paths.append(folder.rstrip("/") + below)
                    lengths.append(file.size)
                    contents.append(content)
                yield out()

    return folders.select("folder").mapInArrow(run, "path STRING, length BIGINT, content BINARY")


def search_folders(folders: DataFrame, wanted: bytes, largest: int | None = None) -> DataFrame:
    """``path, found`` of the files of ``read_folders``: whether ``wanted`` is among their bytes. Files larger than ``largest`` are left
    out; where it is None there are none of them.

    A task reads a file in pieces of ``TOGETHER`` bytes that overlap by what could be cut apart, until it finds ``wanted`` or the file
    ends. So a file may be larger than a row, or the task's memory, can hold."""
    place, listed = _places(), _lister()

    def run(batches):
        def holds(store, file):
            with store.open_input_stream(file.path) as source:
                before = b""
                while piece := source.read(TOGETHER):
                    piece = before + piece
                    if wanted in piece:
                        return True
                    before = piece[len(piece) - min(len(piece), len(wanted) - 1) :]
            return False

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, root = place(folder)
                files = [(b, f) for b, f in listed(store, root) if largest is None or f.size <= largest]
                paths, found = [folder.rstrip("/") + b for b, _ in files], [holds(store, f) for _, f in files]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.bool_())], names=["path", "found"])

    return folders.select("folder").mapInArrow(run, "path STRING, found BOOLEAN")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` to ``folder/name``, and gives ``name, length`` of what was written.

    Tasks write their own rows, each file under another name first, so that a reader never meets half a file and a task
    that is run again does no harm. Rows without a name are left out; null content is an empty file. Of rows with one name any may win.
    """

    place = _places()

    def run(batches):
        store, root = place(folder)
        made = set()
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                above = f"{root}/{name}".rsplit("/", 1)[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(f"{root}/{name}.part") as out:
                    out.write(content)
                store.move(f"{root}/{name}.part", f"{root}/{name}")
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["name", "length"])

    named = rows.where("name is not null").select("name", F.coalesce("content", F.lit(b"")).alias("content"))
    return named.mapInArrow(run, "name STRING, length BIGINT")


def on_disk(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``docs`` whose ``file_path`` is among the scanned ``files``, with the size found there."""
    return docs.drop("file_size").join(files.where("file_size > 0").select("file_path", "file_size"), "file_path")


def list_pdf_files(files: DataFrame) -> DataFrame:
    """``file_path, file_name, base, file_size`` of the PDF files in a ``path, length`` listing."""
    name = tx.base_name(F.col("path"))
    return files.where(F.lower(F.col("path")).endswith(".pdf")).select(
        F.col("path").alias("file_path"),
        name.alias("file_name"),
        tx.without_extension(name).alias("base"),
        F.col("length").alias("file_size"),
    )


def scan_pdf_files(spark: SparkSession, folder: str, largest: int | None = None) -> DataFrame:
    """PDF files with their size. ``content`` is never selected, so file bytes are not read; ``largest`` is a filter of the
    reader, which then passes over larger files."""
    found = read_pdf_bytes(spark, folder).select("path", "length")
    return list_pdf_files(found if largest is None else found.where(F.col("length") <= largest))


def classify_security(files: DataFrame) -> DataFrame:
    """Whether each file's bytes (``path, content``) name an encryption dictionary.

    Bytes cannot tell whether an encrypted file opens without a password, so ``can_be_processed`` is null for those. The search
    is in the bytes; no text is made of them.
    """
    return _security(files, F.contains("content", F.lit(ENCRYPT)))


def _security(files: DataFrame, encrypted: Column) -> DataFrame:
    return files.select(
        F.col("path").alias("file_path"),
        encrypted.alias("is_encrypted"),
        F.when(~encrypted, True).alias("can_be_processed"),
    )


def scan_security(spark: SparkSession, folder: str, largest: int = LARGEST) -> Outcome:
    """The same of all PDF files below ``folder``. Files larger than a row can hold are error rows; the reader gets the limit as
    a filter and never opens them."""
    found = read_pdf_bytes(spark, folder)
    return Outcome(classify_security(found.where(F.col("length") <= largest)), _too_large(found, largest))


def scan_security_of(folders: DataFrame, largest: int | None = None) -> Outcome:
    """The same of all PDF files below each ``folder``, listed and searched by tasks. Files of any size are searched whole; only where
    ``largest`` is given are larger ones error rows instead."""
    errors = _too_large(read_folders(folders), LARGEST if largest is None else largest)
    return Outcome(_security(search_folders(folders, ENCRYPT, largest), F.col("found")), errors.where(F.lit(largest is not None)))


def _too_large(found: DataFrame, largest: int) -> DataFrame:
    return found.select("path", "length").where(F.col("length") > largest).select(
        F.lit(None).cast("bigint").alias("request_id"),
        F.lit(None).cast("bigint").alias("doc_id"),
        F.array(F.concat(F.lit(say.TOO_LARGE), F.col("path"))).alias("errors"),
    )
