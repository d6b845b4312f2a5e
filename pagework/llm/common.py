"""What several operators of this subpackage share: tables, folders of a run, samples of a known size."""

from __future__ import annotations

import ctypes
import io
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.session import shared_folder

# Rows that go through Python together: whole texts can be long, so fewer than Spark's own ten thousand.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder, seen by the driver and every executor, for one run of an operator."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, given as a URI or a path."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parents[2], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted((root / "pagework").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    folder = run_folder(spark, "package")
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/pagework.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/pagework.zip")
    _SHIPPED.add(context.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later jobs read it, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    folder = run_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Returns memory that a task has freed to the system: its Python worker lives on, next to others and the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches, rows: int = SLICE):
    """Arrow batches cut into short ones, so that what is made from them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def slices_by_bytes(batches, rows: int, size: int):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``size`` bytes of their last column, which is text; a
    slice has one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def spread_key(*columns: str) -> Column:
    """A fixed pseudo-random order of rows, the same in every run."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def bounded_sample(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``rows`` rows of ``df``, those with the smallest ``order`` (fewer only where there are fewer). Only that column is read
    to find the border, and rows below it are not moved. Of rows that tie at the border as many as are wanted stay, chosen by
    the hash of their other columns, so one hot key cannot make the sample larger."""
    border = df.select(order).orderBy(order).limit(rows).groupBy(order).count().orderBy(F.desc(order)).first()
    if border is None:
        return df.filter(F.lit(False))
    below, ties = df.filter(F.col(order) < border[0]), df.filter(F.col(order) == border[0])
    others = [c for c in df.columns if c != order]
    return below.union(ties.orderBy(F.xxhash64(*others)).limit(border["count"]))
