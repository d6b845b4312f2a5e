"""Page selection: six ways to write "which pages", and set operations on the result.

A *selection* is one row per request: ``request_id, doc_id, page_count, spans`` with sorted, disjoint spans inside
``1..page_count``. ``selected_pages`` turns it into ``request_id, doc_id, page_no`` rows when those are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import sqltext as sq
from pagework.operators import rows as page_rows
from pagework.operators.rows import (
    Outcome,
    attach_docs,
    block_of,
    each,
    expand,
    full_selection,
    known_docs,
    missing_doc_error,
    present,
    split_outcome,
    spread,
)

LISTED = 10


_LENIENT = {
    "crop": sq.crop_spans("custom_pages"),
    "watermark": sq.watermark_spans("custom_pages"),
    "images": sq.image_spans("pages", "page_ranges"),
    "form": sq.form_spans("pages_text", "ranges_text"),
}
_STRICT = {"split": sq.split_tokens("page_ranges"), "remove": sq.remove_tokens("pages", "page_ranges")}

TOKEN_ERRORS = "transform(filter(_tokens, x -> x.error is not null), x -> x.error)"
TOKEN_SPANS = "transform(_tokens, x -> named_struct('s', x.s, 'e', x.e))"


def strict_tokens(dialect: str) -> Column:
    """All tokens of a strict request, ``{s, e, error}`` each, in the order they are checked."""
    return F.expr(_STRICT[dialect])


def parse_page_spec(requests: DataFrame, docs: DataFrame, dialect: str) -> tuple[DataFrame, DataFrame]:
    """``(selection, errors)`` of requests written in one dialect.

    ``split`` reads ``page_ranges``; ``remove`` reads ``pages`` and ``page_ranges``; ``crop`` and ``watermark`` read
    ``custom_pages``; ``images`` reads ``pages`` and ``page_ranges``; ``form`` reads ``pages_text`` and ``ranges_text``.
    Only the first two know errors besides a missing document.
    """
    known = attach_docs(requests, docs)
    gone = F.col("page_count").isNull()
    if dialect in _LENIENT:
        parsed = known.withColumn("errors", present(missing_doc_error())).withColumn(
            "spans", F.coalesce(F.expr(_LENIENT[dialect]), F.expr(sq.no_spans()))
        )
    elif dialect in _STRICT:
        parsed = (
            known.withColumn("_tokens", strict_tokens(dialect))
            .withColumn("errors", F.when(gone, present(missing_doc_error())).otherwise(F.expr(TOKEN_ERRORS)))
            .withColumn("spans", F.when(F.size("errors") == 0, F.expr(sq.merge(TOKEN_SPANS))))
        )
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    good, bad = split_outcome(parsed.select("request_id", "doc_id", "page_count", "base", "spans", "errors"))
    return good, bad


def selected_pages(selection: DataFrame) -> DataFrame:
    """One ``request_id, doc_id, page_no`` row per selected page."""
    spans = each(selection.select("request_id", "doc_id", "spans"), F.col("spans"), "_x")
    return expand(spans.select("request_id", "doc_id", "_x.s", "_x.e")).select("request_id", "doc_id", "page_no")


def select_pages(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Selection by mode; reads ``mode, custom_pages, start_page, end_page``."""
    known, errors = known_docs(requests, docs)
    return Outcome(
        known.withColumn("spans", F.expr(sq.mode_spans("mode", "custom_pages", "start_page", "end_page"))), errors
    )


def select_stride(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Pages hit by ``even, odd, nth, start`` as ``request_id, doc_id, page_no``; ``nth`` of 0 or less hits none."""
    wanted = F.coalesce(F.col("even"), F.lit(False)) | F.coalesce(F.col("odd"), F.lit(False))
    known, errors = known_docs(requests, docs)
    asked = known.where((F.col("page_count") >= 1) & (wanted | (F.coalesce(F.col("nth"), F.lit(0)) > 0)))
    rows = expand(asked.withColumn("s", F.lit(1)).withColumn("e", F.col("page_count")))
    return Outcome(rows.where(sq.stride_hit()).select("request_id", "doc_id", "page_no"), errors)


def invert_selection(requests: DataFrame, docs: DataFrame, selected: DataFrame) -> Outcome:
    """Pages of each request's document that are not among its ``selected`` rows.

    Requests and selected pages meet by block of pages, a row a block on either side; page rows are made at the end.
    """
    known, errors = known_docs(requests.select("request_id", "doc_id"), docs)
    keys = ["request_id", "doc_id", "_block"]
    taken = selected.select("request_id", "doc_id", block_of(F.col("page_no")).alias("_block"), "page_no")
    marked = spread(taken, *keys).groupBy(*keys).agg(F.collect_set("page_no").alias("_taken"))
    asked = each(known.where("page_count >= 1"), F.sequence(F.lit(0), block_of(F.col("page_count"))), "_block")
    met = asked.select(*keys, "page_count").join(marked, keys, "left")
    first, last = F.col("_block") * page_rows.BLOCK + 1, F.least(F.col("page_count"), (F.col("_block") + 1) * page_rows.BLOCK)
    rest = F.array_except(F.sequence(first, last), F.coalesce("_taken", F.array().cast("array<int>")))
    return Outcome(each(met, rest, "page_no").select("request_id", "doc_id", "page_no"), errors)


def invert_spans(selection: DataFrame) -> DataFrame:
    """The same while the selection still is spans: no shuffle at all."""
    return selection.withColumn("spans", F.expr(sq.complement("spans")))


def union_selection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Selected rows of either side, each once."""
    return a.unionByName(b).dropDuplicates(["request_id", "doc_id", "page_no"])


def compact_selection(selected: DataFrame) -> DataFrame:
    """Runs of consecutive pages: three or more as one ``a-b`` row, shorter ones as single pages.

    Runs are found inside blocks. Only a run that touches a block border can go on in the next block, so only those,
    at most two per block, are looked at across the whole document.
    """
    keys = ["request_id", "doc_id"]
    blocked = selected.select(*keys, "page_no", block_of(F.col("page_no")).alias("_block"))
    inside = Window.partitionBy(*keys, "_block").orderBy("page_no")
    runs = (
        spread(blocked, *keys, "_block")
        .withColumn("_island", F.col("page_no") - F.dense_rank().over(inside))
        .groupBy(*keys, "_block", "_island")
        .agg(F.min("page_no").alias("s"), F.max("page_no").alias("e"))
    )
    on_border = (block_of(F.col("s") - 1) != F.col("_block")) | (block_of(F.col("e") + 1) != F.col("_block"))
    runs = runs.withColumn("_part", F.when(on_border, F.lit(-1)).otherwise(F.col("_block")))
    across = Window.partitionBy(*keys, "_part").orderBy("s")
    opens = F.when(F.col("s") == F.lag("e").over(across) + 1, 0).otherwise(1)
    joined = (
        runs.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_part", "_run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    return _run_tokens(joined.select(*keys, "s", "e"))


def compact_spans(selection: DataFrame) -> DataFrame:
    """The same while the selection still is spans: touching spans are joined inside the row, without a shuffle."""
    runs = each(selection.select("request_id", "doc_id", "spans"), F.expr(sq.runs("spans")), "_run")
    return _run_tokens(runs.select("request_id", "doc_id", "_run.s", "_run.e"))


def _run_tokens(runs: DataFrame) -> DataFrame:
    long_run = F.col("e") - F.col("s") >= 2
    as_range = F.expr("array(named_struct('s', s, 'e', e))")
    as_pages = F.expr("transform(sequence(s, least(e, s + 1)), p -> named_struct('s', p, 'e', p))")
    tokens = each(runs, F.when(long_run, as_range).otherwise(as_pages), "_x")
    ranged = F.col("_x.s") < F.col("_x.e")
    return tokens.select(
        "request_id",
        "doc_id",
        F.when(ranged, "range").otherwise("page").alias("kind"),
        F.col("_x.s").alias("start_page"),
        F.col("_x.e").alias("end_page"),
        F.when(ranged, F.concat_ws("-", "_x.s", "_x.e")).otherwise(F.col("_x.s").cast("string")).alias("token"),
    )


def _info_text(n: Column, listed: Column) -> Column:
    some = F.concat(F.lit("Selected: "), listed, F.lit(" ("), n.cast("string"))
    return (
        F.when(n == 0, F.lit("No pages selected"))
        .when(n == 1, F.concat(some, F.lit(" page)")))
        .when(n <= LISTED, F.concat(some, F.lit(" pages)")))
        .otherwise(F.concat(n.cast("string"), F.lit(" pages selected")))
    )


def selection_summary(selection: DataFrame) -> DataFrame:
    """Per request: pages selected, pages remaining, and the line of text shown; pages are listed up to ten.

    Counted and listed on the request row; no page row is made.
    """
    counted = selection.withColumn("_n", F.expr(sq.count("spans")))
    listed = F.expr(
        f"if(_n <= {LISTED}, array_join(transform(flatten(transform(spans, x -> sequence(x.s, x.e))),"
        " p -> cast(p as string)), ', '), null)"
    )
    n = F.col("_n")
    return counted.select(
        "request_id",
        "doc_id",
        n.alias("selected_count"),
        (F.col("page_count") - n).alias("remaining"),
        _info_text(n, listed).alias("info_text"),
    )


def selected_summary(requests: DataFrame, docs: DataFrame, selected: DataFrame) -> Outcome:
    """The same from ``selected`` rows, which may hold repeats.

    Pages are counted and the first ten kept in each (request, block), so one pass over the rows is enough and what goes on
    to the request is at most ten pages a block.
    """
    keys = ["request_id", "doc_id"]
    blocked = selected.select(*keys, "page_no", block_of(F.col("page_no")).alias("_block"))
    per_block = (
        spread(blocked, *keys, "_block")
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_set("page_no")).alias("_pages"))
        .select(*keys, "_block", F.size("_pages").alias("_k"), F.slice("_pages", 1, LISTED).alias("_first"))
    )
    texts = F.expr(
        f"array_join(transform(slice(array_sort(flatten(collect_list(if(_rank = 1, _first, array())))), 1, {LISTED}),"
        " p -> cast(p as string)), ', ')"
    )
    # Ten blocks hold the first ten pages, whatever each of them holds.
    order = Window.partitionBy(*keys).orderBy("_block")
    firsts = per_block.withColumn("_rank", F.when(F.row_number().over(order) <= LISTED, 1))
    found = firsts.groupBy(*keys).agg(F.sum("_k").cast("int").alias("_n"), texts.alias("_list"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    known, errors = known_docs(requests.select(*keys), docs)
    rows = known.join(found, keys, "left").select(
        *keys,
        n.alias("selected_count"),
        (F.col("page_count") - n).alias("remaining"),
        _info_text(n, F.col("_list")).alias("info_text"),
    )
    return Outcome(rows, errors)
