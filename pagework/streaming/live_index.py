"""The search index kept up to date from a stream of opens.

Owners are dealt to buckets. A micro-batch reads and writes the buckets of its own owners only: their new rows, at most a hundred
per owner, go to ``folder/data/version=N/bucket=K``, and ``folder/pointer/version=N`` says which version each bucket is at. A batch
that is run again after a failure starts from pointer N-1 and overwrites version N, so every open counts once; what a batch
replaces is deleted one batch later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagework.functions import text as tx
from pagework.operators.rows import spread
from pagework.operators.search import KEPT, build_index, cap_index, recent_index

COLUMNS = ["owner", "file_path", "open_count", "last_opened", "file_name"]
INDEX = "owner BIGINT, file_path STRING, open_count BIGINT, last_opened TIMESTAMP_NTZ, file_name STRING"


def read_opens(spark: SparkSession, path: str, sql: list[str], schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of ``owner, file_path, ts`` from parquet files arriving in ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).selectExpr(*sql)


def stream_index(opens: DataFrame) -> DataFrame:
    """Running count and latest open per owner and path. Neither depends on the order in which opens arrive."""
    return opens.groupBy("owner", "file_path").agg(
        F.count("*").alias("open_count"), F.max("ts").alias("last_opened")
    )


BUCKETS = 64
POINTER = "bucket INT, version BIGINT"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.hash("owner"), F.lit(buckets))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _pointer(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """The version of each bucket after batch ``number``; a row a bucket."""
    if number < 0:
        return {}
    rows = spark.read.schema(POINTER).json(f"{folder}/pointer/version={number}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _place(folder: str, bucket: int, version: int) -> str:
    return f"{folder}/data/version={version}/bucket={bucket}"


def _read(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame:
    places = [_place(folder, bucket, version) for bucket, version in sorted(versions.items())]
    return spark.read.schema(INDEX).parquet(*places) if places else spark.createDataFrame([], INDEX)


def _keep_buckets(folder: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], buckets: int):
    """``merge(batch, before)`` gives the new rows of the owners of the batch's buckets, of which ``before`` holds all rows."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            touched = sorted(r[0] for r in batch.where("owner is not null").select(bucket_of(buckets)).distinct().collect())
            pointer = _pointer(spark, folder, number - 1)
            before = {b: pointer[b] for b in touched if b in pointer}
            merged = merge(batch.where("owner is not null"), _read(spark, folder, before) if before else None)
            rows = spread(merged.select(*COLUMNS, bucket_of(buckets).alias("bucket")), "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={number}")
        finally:
            batch.unpersist()
        now = [(b, v) for b, v in sorted({**pointer, **dict.fromkeys(touched, number)}.items())]
        spark.createDataFrame(now, POINTER).coalesce(1).write.mode("overwrite").json(f"{folder}/pointer/version={number}")
        if number > 1:
            for bucket, version in _pointer(spark, folder, number - 2).items():
                if pointer[bucket] != version:
                    _drop(spark, _place(folder, bucket, version))
            if number > 2:
                _drop(spark, f"{folder}/pointer/version={number - 3}")

    return write


def start_live_index(opens: DataFrame, folder: str, keep: int = KEPT, buckets: int = BUCKETS) -> StreamingQuery:
    """The index as if built from all opens at once: counts live in Spark's state, one row per owner and path."""

    def merge(changed: DataFrame, before: DataFrame | None) -> DataFrame:
        current = changed.withColumn("file_name", tx.base_name(F.col("file_path"))).select(*COLUMNS)
        if before is not None:
            untouched = before.join(current.select("owner", "file_path"), ["owner", "file_path"], "left_anti")
            current = untouched.select(*COLUMNS).unionByName(current)
        return cap_index(current, keep)

    return _start(stream_index(opens).writeStream.outputMode("update"), _keep_buckets(f"{folder}/index", merge, buckets), folder)


def start_bounded_index(opens: DataFrame, folder: str, keep: int = KEPT, buckets: int = BUCKETS) -> StreamingQuery:
    """The index with nothing remembered beyond itself: a file that fell out and is opened again starts at 1.

    Files fall out at the end of a micro-batch. There is no other state, so what is kept never exceeds ``keep`` per owner.
    """

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        current = build_index(batch).select(*COLUMNS)
        if before is not None:
            current = current.unionByName(before.select(*COLUMNS))
        added = current.groupBy("owner", "file_path", "file_name").agg(
            F.sum("open_count").alias("open_count"), F.max("last_opened").alias("last_opened")
        )
        return cap_index(added, keep)

    return _start(opens.writeStream.outputMode("append"), _keep_buckets(f"{folder}/index", merge, buckets), folder)


def start_recent_index(opens: DataFrame, folder: str, keep: int = KEPT, buckets: int = BUCKETS) -> StreamingQuery:
    """The index after taking in every open in turn, files that fell out starting again at 1, wherever the micro-batches are cut.

    What is kept of an owner, at most ``keep`` rows, is all that is remembered. Opens are in order within a micro-batch; one that comes
    in a later batch than opens after it counts where it comes."""

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        return recent_index(batch, keep, before)

    return _start(opens.writeStream.outputMode("append"), _keep_buckets(f"{folder}/index", merge, buckets), folder)


def _start(writer, write, folder: str) -> StreamingQuery:
    return (
        writer.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def finish(spark: SparkSession, query: StreamingQuery, folder: str) -> DataFrame:
    """Waits until all opens that were there are taken in, and reads the newest version that was written to its end.

    That is the version of an earlier run where this one found nothing new.
    """
    query.awaitTermination()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index/pointer/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    numbers = [int(f.getPath().getParent().getName().removeprefix("version=")) for f in found]
    if not numbers:
        raise RuntimeError("no opens arrived")
    return _read(spark, f"{folder}/index", _pointer(spark, f"{folder}/index", max(numbers)))
