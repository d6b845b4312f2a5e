"""Writing a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.operators.rows import block_of
from pagework.session import shuffle_partitions


MANIFEST = "request_id BIGINT, doc_id BIGINT, output_name STRING, part_no INT, out_no INT, page_no INT, rotation INT"


def write_manifest(manifest: DataFrame, path: str, by_output: bool = False) -> None:
    """Parquet in output order; with ``by_output`` one directory per output.

    Rows are spread by (output, block of positions) over as many tasks as shuffles have, so neither many short outputs nor a
    long one leave tasks idle. Within a file outputs and positions are sorted, which lets readers skip by their min and max.
    """
    spread = manifest.repartition(shuffle_partitions(manifest.sparkSession), "output_name", block_of(F.col("out_no")))
    writer = spread.sortWithinPartitions("output_name", "out_no").write.mode("overwrite")
    (writer.partitionBy("output_name") if by_output else writer).parquet(path)


def save_manifest(manifest: DataFrame, name: str, path: str, buckets: int) -> None:
    """The manifest as table ``name`` in ``buckets`` by output, files below ``path``: tables saved alike are joined or grouped by
    ``output_name`` without a shuffle. For very many outputs, where a directory each is too much.

    Rows go by (bucket, block of positions), so that a long output is written by many tasks and short ones make one file a bucket.
    """
    bucket = F.pmod(F.hash("output_name"), F.lit(buckets))  # as the table's own buckets
    block = block_of(F.col("out_no")) if "out_no" in manifest.columns else F.lit(0)
    dealt = manifest.repartition(shuffle_partitions(manifest.sparkSession), bucket, block)
    order = [c for c in ("output_name", "out_no") if c in manifest.columns]
    dealt.write.mode("overwrite").bucketBy(buckets, "output_name").sortBy(*order).option("path", path).saveAsTable(name)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as written; nothing is inferred, so names such as ``0012`` stay text. Columns it lacks are null."""
    return spark.read.schema(MANIFEST).parquet(path)
