"""Turning spans into page rows, and joining page tables, without a hot document landing in one task.

Pages are grouped into blocks of ``BLOCK`` consecutive numbers. A document of any length is many blocks, so whatever is
partitioned by (document, block) stays small; what has to be known across blocks is carried by one row per block.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.functions import sqltext as sq
from pagework.session import shuffle_partitions

BLOCK = 4096


class Outcome(NamedTuple):
    """Output rows of the requests that hold, and ``request_id, doc_id, errors`` of those that do not."""

    rows: DataFrame
    errors: DataFrame


def block_of(number: Column) -> Column:
    return F.floor((number - 1) / BLOCK).cast("int")


def attach_docs(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests with their document's ``page_count`` and ``base``; both are null where the document is missing.

    The join type is left to Spark, which broadcasts only a side it has sized, and splits a document asked for too often.
    """
    return requests.join(docs.select("doc_id", "page_count", "base"), "doc_id", "left")


def missing_doc_error() -> Column:
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.when(F.col("page_count").isNull(), F.concat(F.lit(say.FILE_NOT_FOUND), named))


def known_docs(requests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their document's facts, and the error rows of those whose document is missing."""
    attached = attach_docs(requests, docs)
    return split_outcome(attached.withColumn("errors", present(missing_doc_error())))


def present(*messages: Column) -> Column:
    """The given texts as an array without the nulls."""
    return F.filter(F.array(*messages), lambda x: x.isNotNull())


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by all of ``keys``.

    Needed even where a window by the same keys follows: a table that is already laid out by the first key alone would
    satisfy that window, and a hot first key would stay in one task.
    """
    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys)


def each(rows: DataFrame, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of ``array``; none where it is empty or null.

    A plain explode makes Spark add a filter on the array's size, which moves down to the scan and works the whole array
    out a second time. The outer form has no such filter, and the one on its output cannot move.
    """
    if position is None:
        out = rows.select("*", F.explode_outer(array).alias(name))
    else:
        out = rows.select("*", F.posexplode_outer(array).alias(position, name))
    return out.where(F.col(name).isNotNull())


def if_sound(array: Column) -> Column:
    """``array`` where the request has no ``errors``, else null, so that ``each`` yields nothing for it."""
    return F.when(F.size("errors") == 0, array)


def error_part(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0).select("request_id", "doc_id", "errors")


def split_outcome(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the error rows, from a table that carries ``errors``."""
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0).select("request_id", "doc_id", "errors")
    return good, bad


def expand(rows: DataFrame, start: str = "s", end: str = "e", out: str = "page_no", deal: tuple[str, ...] = ()) -> DataFrame:
    """One row per number in ``start..end``.

    Long spans are first cut at block borders and the short rows are spread by (request, block), so that a document
    holding a large part of all pages is expanded by many tasks; ``deal`` names further columns to spread by, where a request has
    many short spans. The fixed partition count keeps adaptive execution from
    packing these small rows together again just before they multiply.
    """
    keys = ["request_id"] if "request_id" in rows.columns else ["doc_id"]
    cut = each(rows, F.sequence(block_of(F.col(start)), block_of(F.col(end))), "_block")
    cut = spread(cut, *keys, *deal, "_block")
    first = F.greatest(F.col(start), F.col("_block") * BLOCK + 1)
    last = F.least(F.col(end), (F.col("_block") + 1) * BLOCK)
    return each(cut, F.sequence(first, last), out).drop("_block")


def join_pages(selection: DataFrame, pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``pages`` (or any table by ``doc_id, page_no``) that lie in a request's ``spans``.

    The selection side is one row per span and block it touches, so both sides meet on (document, block). Spans of one
    request do not overlap, hence a page meets a request at most once. ``keep`` names further fields of the spans.
    """
    cut = each(selection, F.col("spans"), "_spans").drop("spans", "page_count", "base", "errors")
    cut = each(cut, F.sequence(block_of(F.col("_spans.s")), block_of(F.col("_spans.e"))), "_block")
    page_rows = pages.withColumn("_block", block_of(F.col("page_no")))
    met = cut.join(page_rows, ["doc_id", "_block"]).where(F.col("page_no").between(F.col("_spans.s"), F.col("_spans.e")))
    return met.withColumns({name: F.col(f"_spans.{name}") for name in keep}).drop("_block", "_spans")


def join_all_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page of each request's document; the request side needs ``page_count`` and fans out to its blocks."""
    return join_pages(full_selection(requests), pages)


def mark_positions(manifest: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``marked``, ``marked_before``, ``rows_total`` and ``marked_upto`` to a manifest numbered 1..n by ``out_no``.

    ``marks`` holds ``keys, out_no``; repeats and positions outside 1..n do not count. Manifest rows, marks and one header row
    per block meet in one shuffle by (keys, block), where a single ordered window counts. The header brings what lies in
    earlier blocks; it is worked out from one row per block and the manifest's sizes, which combine before their shuffle.
    """
    sizes = manifest.groupBy(*keys).agg(F.max("out_no").alias("rows_total"))
    per_block = (
        marks.where(F.col("out_no") >= 1)
        .groupBy(*keys, block_of(F.col("out_no")).alias("_block"))
        .agg(F.collect_set("out_no").alias("_marks"))
    )
    headers = each(sizes, F.sequence(F.lit(0), block_of(F.col("rows_total"))), "_block")
    counts = per_block.select(*keys, F.lit(None).cast("int").alias("rows_total"), "_block", F.size("_marks").alias("_k"))
    # A block's header stands before its count, so that only earlier blocks are summed.
    earlier = Window.partitionBy(*keys).orderBy("_block", F.col("rows_total").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        headers.withColumn("_k", F.lit(0))
        .unionByName(counts)
        .withColumn("_carry", F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
        .where(F.col("rows_total").isNotNull())
        .select(*keys, "_block", "rows_total", "_carry")
    )
    sound = each(per_block, F.col("_marks"), "out_no").select(*keys, "_block", "out_no", F.lit(1).alias("_mark"))
    both = (
        manifest.select("*", block_of(F.col("out_no")).alias("_block"), F.lit(0).alias("_mark"))
        .unionByName(sound, allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
    )
    # The header first, then by position, a mark before the row it marks.
    order = Window.partitionBy(*keys, "_block").orderBy(F.col("out_no").asc_nulls_first(), F.desc("_mark"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = spread(both, *keys, "_block").withColumns(
        {
            "_seen": F.sum("_mark").over(upto),
            "_last": F.last(F.when(F.col("_mark") == 1, F.col("out_no")), ignorenulls=True).over(upto),
            "_start": F.first("_carry", ignorenulls=True).over(upto),
            "_total": F.first("rows_total", ignorenulls=True).over(upto),
        }
    )
    marked = F.coalesce(F.col("_last") == F.col("out_no"), F.lit(False))
    return counted.where("_mark = 0").select(
        *manifest.columns,
        marked.alias("marked"),
        (F.col("_start") + F.col("_seen") - marked.cast("int")).alias("marked_before"),
        (F.col("_start") + F.col("_seen")).alias("marked_upto"),
        F.col("_total").alias("rows_total"),
    )


def full_selection(requests: DataFrame) -> DataFrame:
    return requests.withColumn("spans", F.expr(sq.whole()))
