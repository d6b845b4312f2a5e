"""Document metadata: reading with fallbacks, editing, stripping, dates, completeness.

Documents carry ``doc_id, info MAP<STRING,STRING>, xmp STRING``. Everything here is a projection, but for edits, which
join one edit row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pagework.functions import messages as say
from pagework.functions import text as tx
from pagework.operators.rows import Outcome, present, spread

# Info keys, XMP tags and alternative Info keys behind each field.
INFO_KEYS = {
    "title": "Title",
    "author": "Author",
    "subject": "Subject",
    "keywords": "Keywords",
    "creator": "Creator",
    "producer": "Producer",
    "creation_date": "CreationDate",
    "modification_date": "ModDate",
}
XMP_TAGS = {
    "title": "dc:title",
    "author": "dc:creator",
    "subject": "dc:description",
    "keywords": "pdf:Keywords",
    "creator": "xmp:CreatorTool",
    "producer": "pdf:Producer",
}
ALTERNATIVE_KEYS = {"author": "Authors", "creator": "SourceApplication", "producer": "PDFProducer"}
GATED = list(XMP_TAGS)
REQUIRED = ["title", "author"]


def info_value(key: str, info: str = "info") -> Column:
    return tx.blank_to_null(F.try_element_at(F.col(info), F.lit(key)))


def read_info(docs: DataFrame) -> DataFrame:
    """The eight Info values, trimmed, blank ones null."""
    return docs.select("doc_id", *[info_value(key).alias(field) for field, key in INFO_KEYS.items()])


def tag_text(packet: Column, tag: str) -> Column:
    """Text from the first ``<tag`` to the next ``</tag>``, without a CDATA wrapper; blank or unclosed is null.

    ``<tag`` is a prefix search, and markup inside the value stays. Each step feeds the next once, so the generated code
    stays small however many tags are read.
    """
    closing = f"</{tag}>"
    found = F.when(F.contains(packet, F.lit(closing)), F.regexp_extract(packet, rf"(?s)<\Q{tag}\E[^>]*>(.*?)\Q{closing}\E", 1))
    bare = F.regexp_replace(tx.strip(found), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    return F.nullif(F.regexp_replace(bare, f"^[{tx.DOTNET_BLANKS}]+$", ""), F.lit(""))


def extract_tag(df: DataFrame, column: str, tag: str, out: str = "value") -> DataFrame:
    return df.withColumn(out, tag_text(F.col(column), tag))


def _all_empty(values: dict[str, Column]) -> Column:
    found = F.coalesce(*[values[field] for field in GATED])
    return found.isNull()


def resolve_metadata(docs: DataFrame) -> DataFrame:
    """Metadata of each document: Info; XMP where all six fields are empty there; alternative keys where still so.

    The gate is the whole document, not the single field, and dates never fall back.
    """
    plain = docs.select("*", *[info_value(key).alias(field) for field, key in INFO_KEYS.items()])
    packets = plain.withColumn("_gate", _all_empty({f: F.col(f) for f in GATED}))
    from_xmp = packets.select(
        *[c for c in packets.columns if c not in GATED],
        *[F.when(F.col("_gate"), tag_text(F.col("xmp"), XMP_TAGS[f])).otherwise(F.col(f)).alias(f) for f in GATED],
    )
    still = from_xmp.withColumn("_gate", _all_empty({f: F.col(f) for f in GATED}))
    last = {f: F.when(F.col("_gate"), info_value(key)).otherwise(F.col(f)) for f, key in ALTERNATIVE_KEYS.items()}
    return still.select("doc_id", *[last.get(f, F.col(f)).alias(f) for f in INFO_KEYS], "page_count")


def apply_metadata_edits(docs: DataFrame, edits: DataFrame) -> Outcome:
    """Documents with their edit applied: a field with text is set, a blank or missing one is deleted.

    ``edits`` has one ``doc_id, metadata STRUCT`` row per document to change; dates and other keys stay. A null struct, a
    document that is not there, and several edits of one document are errors and change nothing. Documents without an edit
    row stay as they are.
    """
    once = edits.groupBy("doc_id").agg(F.count("*").alias("_edits"), F.first("metadata").alias("metadata"))
    marked = once.where("_edits = 1").select("doc_id", "metadata", F.lit(True).alias("_edited"))
    wanted = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(INFO_KEYS[f]) for f in GATED]), F.array(*[F.col(f"metadata.{f}") for f in GATED])
        ),
        lambda _, v: ~tx.is_blank(v),
    )
    owned = [INFO_KEYS[f] for f in GATED]
    rest = F.map_filter(F.col("info"), lambda k, _: ~k.isin(*owned))
    edit = F.col("_edited") & F.col("metadata").isNotNull()
    changed = docs.join(marked, "doc_id", "left").withColumn(
        "info", F.when(edit, F.map_concat(rest, wanted)).otherwise(F.col("info"))
    )
    there = docs.select("doc_id", F.lit(True).alias("_there"))
    said = present(
        F.when(F.col("_there").isNull(), F.concat(F.lit(say.FILE_NOT_FOUND), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        F.when(F.col("_edits") > 1, F.lit(say.ONE_EDIT)),
        F.when((F.col("_edits") == 1) & F.col("metadata").isNull(), F.lit(say.NO_METADATA)),
    )
    errors = once.join(there, "doc_id", "left").select(F.col("doc_id").alias("request_id"), "doc_id", said.alias("errors"))
    return Outcome(changed.select(*docs.columns), errors.where(F.size("errors") > 0))


BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("doc_id"), F.lit(buckets))


def write_documents(docs: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Documents as a table by bucket of ``doc_id``, one directory a bucket."""
    rows = spread(docs.withColumn("bucket", _bucket(buckets)), "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_documents(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).parquet(folder).drop("bucket")


def rewrite_metadata(edits: DataFrame, folder: str, schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """Applies ``edits`` to a table that ``write_documents`` wrote with as many ``buckets``, in place; gives the error rows.

    Only buckets that hold an edited document are read and written; the files of all others stay as they are. New files take
    the place of a bucket's old ones when all of them are written. A run that is repeated changes nothing more.
    """
    spark = edits.sparkSession
    touched = [r[0] for r in edits.select(_bucket(buckets)).distinct().collect()]  # at most ``buckets``

    def outcome() -> Outcome:
        table = spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).parquet(folder)
        return apply_metadata_edits(table.where(F.col("bucket").isin(touched)).drop("bucket"), edits)

    rows = spread(outcome().rows.withColumn("bucket", _bucket(buckets)), "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return outcome().errors  # of the new files; they compare ids, which no edit changes


def strip_metadata(docs: DataFrame, flag: Column) -> DataFrame:
    """Info dictionary and XMP packet emptied where ``flag`` holds."""
    strip = F.coalesce(flag, F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    return docs.withColumn("info", F.when(strip, empty).otherwise(F.col("info"))).withColumn(
        "xmp", F.when(~strip, F.col("xmp"))
    )


def format_pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS…`` as ``YYYY-MM-DD HH:mm:SS`` cut by position; other text stays, none is ``Not set``."""

    def cut(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    shown = F.concat(
        cut(3, 4), F.lit("-"), cut(7, 2), F.lit("-"), cut(9, 2), F.lit(" "),
        cut(11, 2), F.lit(":"), cut(13, 2), F.lit(":"), cut(15, 2),
    )
    return (
        F.when(text.isNull() | (text == ""), F.lit("Not set")).when(text.startswith("D:"), shown).otherwise(text)
    )


def pdf_timestamp(text: Column) -> Column:
    """The same as a timestamp without zone, null where it is not a full date and time."""
    found = text.rlike("^D:[0-9]{14}")

    def part(start: int, length: int) -> Column:
        return F.when(found, F.substring(text, start, length).try_cast("int"))

    return F.try_make_timestamp_ntz(part(3, 4), part(7, 2), part(9, 2), part(11, 2), part(13, 2), part(15, 2))


def metadata_completeness(metadata: DataFrame) -> DataFrame:
    """Which of the required fields are missing, on resolved metadata."""
    missing = F.filter(
        F.array(*[F.when(tx.is_blank(F.col(f), tx.SCRIPT_BLANKS), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull()
    )
    return metadata.select("doc_id", missing.alias("missing"), (F.size(missing) == 0).alias("is_complete"))
