"""Which pages go to which output, and in which order: split, remove, organize, edit, merge.

Manifest rows are ``request_id, doc_id, output_name, part_no, out_no, page_no``. Where a position can be worked out from
the request alone it is, so most operators need one join with the document table and no window over pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.functions import numbers as nu
from pagework.functions import sqltext as sq
from pagework.functions import text as tx
from pagework.operators.rows import (
    Outcome,
    attach_docs,
    block_of,
    each,
    error_part,
    expand,
    if_sound,
    mark_positions,
    missing_doc_error,
    present,
    split_outcome,
)
from pagework.operators.selection import TOKEN_ERRORS, TOKEN_SPANS, strict_tokens

PLAN = ["request_id", "doc_id", "output_name", "part_no", "out_no", "page_no"]

# Endings of the names of whole-document outputs.
OUTPUT_ENDINGS = {
    "split": "_split.zip",
    "remove": "_removed_pages.pdf",
    "organize": "_organized.pdf",
    "numbers": "_numbered.pdf",
    "crop": "_cropped.pdf",
    "watermark": "_watermarked.pdf",
    "render": "_images.zip",
    "compress": "_compressed.pdf",
    "metadata": "_updated.pdf",
    "lock": "_locked.pdf",
    "unlock": "_unlocked.pdf",
}


def output_name(tool: str, base: Column) -> Column:
    return F.concat(base, F.lit(OUTPUT_ENDINGS[tool]))


def part_name(base: Column, part: Column, start: Column, end: Column) -> Column:
    return tx.message(base, "_part", part, "_pages", start, "-", end, ".pdf")


def _plan_parts(parts: DataFrame) -> DataFrame:
    """Rows with ``part_no, s, e`` expanded to manifest rows."""
    named = parts.withColumn("output_name", part_name(F.col("base"), F.col("part_no"), F.col("s"), F.col("e")))
    return expand(named).withColumn("out_no", F.col("page_no") - F.col("s") + 1).select(*PLAN)


def _each_part(checked: DataFrame, spans: Column) -> DataFrame:
    return each(checked, if_sound(spans), "_x", "_pos").select(
        "request_id", "doc_id", "base", (F.col("_pos") + 1).alias("part_no"), "_x.s", "_x.e"
    )


def split_by_ranges(requests: DataFrame, docs: DataFrame) -> Outcome:
    """One part per entry of ``page_ranges`` in the order given; parts may overlap."""
    known = attach_docs(requests, docs).withColumn("_tokens", strict_tokens("split"))
    errors = (
        F.when(F.col("page_count").isNull(), present(missing_doc_error()))
        .when(F.size("_tokens") == 0, F.array(F.lit(say.NO_RANGES)))
        .otherwise(F.expr(TOKEN_ERRORS))
    )
    checked = known.withColumn("errors", errors)
    return Outcome(_plan_parts(_each_part(checked, F.expr(TOKEN_SPANS))), error_part(checked))


def split_at_pages(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Parts end after each of ``split_points``; repeated points and points outside ``1..count-1`` are errors."""
    known = attach_docs(requests, docs).withColumn("_points", F.array_sort("split_points"))
    outside = F.expr("exists(_points, p -> p not between 1 and page_count - 1)")
    repeated = F.size(F.array_distinct("_points")) < F.size("_points")
    errors = present(
        F.coalesce(
            missing_doc_error(),
            F.when(F.coalesce(F.size("_points"), F.lit(0)) <= 0, F.lit(say.NO_POINTS)),
            F.when(F.exists("_points", lambda p: p.isNull()), F.lit(say.NO_POINT)),
            F.when(
                outside | repeated,
                tx.message(say.BAD_POINTS, F.col("page_count") - 1),
            ),
        )
    )
    checked = known.withColumn("errors", errors)
    parts = F.expr(
        "zip_with(concat(array(1), transform(_points, p -> p + 1)), concat(_points, array(page_count)),"
        " (a, b) -> named_struct('s', a, 'e', b))"
    )
    return Outcome(_plan_parts(_each_part(checked, parts)), error_part(checked))


def split_every_n(pages: DataFrame, interval: int | Column) -> DataFrame:
    """Parts of N pages each, straight from the page table: a projection, no join and no shuffle.

    ``pages`` carries ``doc_id, page_no, page_count, base``. A column as ``interval`` must be at least 1.
    """
    if isinstance(interval, int):
        if interval < 1:
            raise ValueError(say.BAD_INTERVAL)
        interval = F.lit(interval)
    part = F.floor((F.col("page_no") - 1) / interval).cast("int") + 1
    start = (part - 1) * interval + 1
    end = F.least(part * interval, F.col("page_count"))
    kept = [c for c in ("request_id",) if c in pages.columns]
    return pages.select(
        *kept,
        "doc_id",
        part_name(F.col("base"), part, start, end).alias("output_name"),
        part.alias("part_no"),
        (F.col("page_no") - start + 1).alias("out_no"),
        "page_no",
    )


def split_every_n_requests(requests: DataFrame, docs: DataFrame) -> Outcome:
    """The same from requests with ``page_interval``; an interval that is missing or below 1 is an error."""
    bad_interval = F.coalesce(F.col("page_interval"), F.lit(0)) < 1
    errors = present(
        F.coalesce(missing_doc_error(), F.when(bad_interval, F.lit(say.BAD_INTERVAL)))
    )
    good, bad = split_outcome(attach_docs(requests, docs).withColumn("errors", errors))
    rows = expand(good.where(F.col("page_count") >= 1).withColumn("s", F.lit(1)).withColumn("e", F.col("page_count")))
    return Outcome(split_every_n(rows, F.col("page_interval")), bad)


def extract_all(pages: DataFrame) -> DataFrame:
    """Every page as an output of its own."""
    return pages.select(
        "doc_id",
        tx.message(F.col("base"), "_page", F.col("page_no"), ".pdf").alias("output_name"),
        F.col("page_no").alias("part_no"),
        F.lit(1).alias("out_no"),
        "page_no",
    )


def _progression(upto: str, first: str, step: str) -> str:
    return f"if({step} is not null and {upto} >= {first}, ({upto} - {first}) div {step} + 1, 0L)"


def _strided(upto: str) -> str:
    """How many of the pages ``1..upto`` are even, odd or on the stride, each counted once, in closed form."""
    return f"""if(_even and _odd, cast({upto} as bigint),
        case when _even then {upto} div 2 when _odd then ({upto} + 1) div 2 else 0L end
        + {_progression(upto, "_first", "_step")} - {_progression(upto, "_both_first", "_both_step")})"""


def _with_strides(requests: DataFrame) -> DataFrame:
    """Adds the stride as its first page and step, and what it shares with the even or odd pages in the same form."""
    begin = "cast(coalesce(start, nth) as bigint)"
    return (
        requests.withColumns(
            {
                "_even": F.expr("coalesce(even, false)"),
                "_odd": F.expr("coalesce(odd, false)"),
                "_step": F.expr("if(nth > 0, cast(nth as bigint), null)"),
            }
        )
        .withColumn("_first", F.expr(f"if({begin} >= 1, {begin}, pmod({begin} - 1, _step) + 1)"))
        .withColumn("_meets", F.expr("_first % 2 = if(_even, 0, 1)"))
        .withColumns(
            {
                "_both_first": F.expr("if(_meets or _step % 2 = 0, _first, _first + _step)"),
                "_both_step": F.expr(
                    "case when not _even and not _odd then null when _step % 2 = 1 then 2 * _step when _meets then _step end"
                ),
            }
        )
    )


def remove_pages(requests: DataFrame, docs: DataFrame) -> Outcome:
    """What is left after removing listed pages, ranges, even, odd and every-Nth pages, renumbered.

    Ranges are kept as spans and strides are counted in closed form, so new positions come from the request row itself:
    no anti-join and no window over pages.
    """
    known = (
        _with_strides(attach_docs(requests, docs))
        .withColumn("_tokens", strict_tokens("remove"))
        .withColumn("_faults", F.expr(TOKEN_ERRORS))
        .withColumn("_gone", F.expr(f"if(size(_faults) = 0, {sq.merge(TOKEN_SPANS)}, null)"))
        .withColumn("_spans", F.expr(sq.complement("_gone")))
        .withColumn(
            "_pieces",
            F.expr(
                "transform(_spans, x -> named_struct('s', x.s, 'e', x.e, 'before',"
                f" {_strided('(x.s - 1)')}, 'hit', {_strided('x.e')}))"
            ),
        )
        .withColumn("_remaining", F.expr("aggregate(_pieces, 0L, (n, x) -> n + x.e - x.s + 1 - (x.hit - x.before))"))
    )
    no_criterion = (F.size("_tokens") == 0) & ~F.col("_even") & ~F.col("_odd") & F.col("nth").isNull()
    errors = (
        F.when(F.col("page_count").isNull(), present(missing_doc_error()))
        .when(no_criterion, F.array(F.lit(say.NO_CRITERION)))
        .when(F.size("_faults") > 0, F.col("_faults"))
        .when(F.col("_remaining") <= 0, F.array(F.lit(say.NOTHING_LEFT)))
        .otherwise(F.array().cast("array<string>"))
    )
    checked = known.withColumn("errors", errors)
    # ``skip`` turns a page number into its new position once the strided pages before it are taken off too.
    left = "x.e - x.s + 1 - (x.hit - x.before)"
    placed = F.expr(
        sq.folded(
            "_pieces",
            "0L",
            f"acc.h + aggregate(c, 0L, (n, x) -> n + {left})",
            "aggregate(c, named_struct('out', cast(array() as array<struct<s:int,e:int,skip:bigint>>), 'kept', h),"
            " (t, x) -> named_struct("
            "  'out', array_append(t.out, named_struct('s', x.s, 'e', x.e, 'skip', x.s - 1 - x.before - t.kept)),"
            f"  'kept', t.kept + {left}), t -> t.out)",
        )
    )
    strides = ["even", "odd", "nth", "start", "_even", "_odd", "_step", "_first", "_both_first", "_both_step"]
    pieces = each(checked, if_sound(placed), "_x").select(
        "request_id", "doc_id", "base", *strides, "_x.s", "_x.e", "_x.skip"
    )
    rows = expand(pieces).where(f"not ({sq.stride_hit()})")
    return Outcome(
        rows.select(
            "request_id",
            "doc_id",
            output_name("remove", F.col("base")).alias("output_name"),
            F.lit(1).alias("part_no"),
            F.expr(f"cast(page_no - ({_strided('page_no')}) - skip as int)").alias("out_no"),
            "page_no",
        ),
        error_part(checked),
    )


def organize_pages(requests: DataFrame, docs: DataFrame, pages: DataFrame) -> Outcome:
    """Pages in the order of ``page_order``, each turned by its rotation on top of the page's own."""
    faults = F.expr(
        f"concat(transform(filter(page_order, x -> x.page_number is null), x -> '{say.NO_PAGE}'),"
        " transform(filter(page_order, x -> x.page_number not between 1 and page_count),"
        " x -> concat('Page number ', x.page_number, ' is out of range (1-', page_count, ')')),"
        " transform(filter(page_order, x -> x.rotation % 90 <> 0),"
        f" x -> concat('{say.BAD_TURN}', x.rotation)))"
    )
    errors = (
        F.when(F.col("page_count").isNull(), present(missing_doc_error()))
        .when(F.coalesce(F.size("page_order"), F.lit(0)) <= 0, F.array(F.lit(say.NO_ORDER)))
        .otherwise(faults)
    )
    checked = attach_docs(requests, docs).withColumn("errors", errors)
    steps = each(checked, if_sound(F.col("page_order")), "_x", "_pos").select(
        "request_id",
        "doc_id",
        output_name("organize", F.col("base")).alias("output_name"),
        F.lit(1).alias("part_no"),
        (F.col("_pos") + 1).alias("out_no"),
        F.col("_x.page_number").alias("page_no"),
        F.coalesce(F.col("_x.rotation"), F.lit(0)).alias("_turn"),
    )
    rows = steps.join(pages.select("doc_id", "page_no", F.col("rotation").alias("_own")), ["doc_id", "page_no"])
    return Outcome(rows.select(*PLAN, nu.quarter_turn(F.col("_own") + F.col("_turn")).alias("rotation")), error_part(checked))


def rotate_pages(manifest: DataFrame, clicks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each row of ``clicks`` (keys, out_no) turns that page by 90 degrees."""
    keys = keys or ["doc_id"]
    turns = clicks.groupBy(*keys, "out_no").agg(F.count("*").alias("_turns"))
    quarter = F.coalesce(F.col("_turns"), F.lit(0)) % 4 * 90
    return (
        manifest.join(turns, [*keys, "out_no"], "left")
        .withColumn("rotation", nu.quarter_turn(F.col("rotation") + quarter))
        .select(*manifest.columns)
    )


def duplicate_pages(manifest: DataFrame, marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Marked pages are followed by a copy of themselves; later pages move down."""
    keys = keys or ["doc_id"]
    marked = mark_positions(manifest, marks, keys)
    copies = F.when(F.col("marked"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    moved = each(marked, copies, "copy_no").withColumn(
        "out_no", (F.col("out_no") + F.col("marked_before") + F.col("copy_no")).cast("int")
    )
    return moved.select(*manifest.columns, "copy_no")


def delete_pages(manifest: DataFrame, marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Marked pages go, one after another in page order; the last page that remains cannot be deleted."""
    keys = keys or ["doc_id"]
    marked = mark_positions(manifest, marks, keys)
    last_of_none = (F.col("out_no") == F.col("rows_total")) & (F.col("marked_upto") == F.col("rows_total"))
    kept = marked.where(~F.col("marked") | last_of_none)
    return kept.withColumn("out_no", (F.col("out_no") - F.col("marked_before")).cast("int")).select(*manifest.columns)


def move_page(manifest: DataFrame, moves: DataFrame, keys: list[str] | None = None) -> Outcome:
    """One move per key: the page at ``from_no`` is taken out and put in at the old place of ``to_no``.

    Positions are 1..n, so the shift of every other page follows from the two numbers; nothing is sorted. A move from or
    to a position outside the manifest does nothing. The move is copied to each block of its manifest, so a long one is
    joined by many tasks. Several moves of one key, and moves of a key without pages, are errors, and move nothing.
    """
    keys = keys or ["doc_id"]
    pos, here, there = F.col("out_no"), F.col("from_no"), F.col("to_no")
    moved = (
        F.when(pos == here, there)
        .when((here < pos) & (pos <= there), pos - 1)
        .when((there <= pos) & (pos < here), pos + 1)
        .otherwise(pos)
    )
    sizes = manifest.groupBy(*keys).agg(F.max("out_no").alias("_n"))
    once = moves.groupBy(*keys).agg(
        F.count("*").alias("_moves"), F.first("from_no").alias("from_no"), F.first("to_no").alias("to_no")
    )
    known = once.join(sizes, keys, "left")
    sound = known.where((F.col("_moves") == 1) & here.between(1, F.col("_n")) & there.between(1, F.col("_n")))
    fanned = each(sound, F.sequence(F.lit(0), block_of(F.col("_n"))), "_block")
    joined = manifest.withColumn("_block", block_of(pos)).join(fanned, [*keys, "_block"], "left")
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    errors = present(
        F.when(F.col("_n").isNull(), F.concat(F.lit(say.FILE_NOT_FOUND), named)),
        F.when(F.col("_moves") > 1, F.lit(say.ONE_MOVE)),
    )
    faults = known.select(F.col(keys[0]).alias("request_id"), F.col(keys[-1]).alias("doc_id"), errors.alias("errors"))
    return Outcome(joined.withColumn("out_no", moved.cast("int")).select(*manifest.columns), faults.where(F.size("errors") > 0))


def listed_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One row per entry of ``files`` of a request, with the facts of that file, or nulls where it is missing."""
    entries = requests.select("request_id", F.posexplode("files").alias("file_pos", "file_path"))
    return entries.join(files, "file_path", "left")


def merge_docs(requests: DataFrame, docs: DataFrame, dedupe: bool = False) -> Outcome:
    """Documents of ``files`` one after another. ``dedupe`` drops later repeats of a path.

    Each file's first output position is the sum of the page counts before it in its request's list, so the window runs
    over list entries, which came out of one row, and never over pages.
    """
    asked = requests.withColumn("files", F.array_distinct("files")) if dedupe else requests
    entries = listed_files(asked, docs.select("file_path", "doc_id", "page_count"))
    in_request = Window.partitionBy("request_id")
    earlier = in_request.orderBy("file_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("_gone", F.count_if(F.col("doc_id").isNull()).over(in_request)).withColumn(
        "_offset", F.coalesce(F.sum("page_count").over(earlier), F.lit(0))
    )
    bad = (
        placed.where(F.col("doc_id").isNull())
        .groupBy("request_id")
        .agg(
            F.expr(
                "transform(array_sort(collect_list(struct(file_pos, file_path))),"
                f" x -> concat('{say.FILE_NOT_FOUND}', coalesce(x.file_path, '')))"
            ).alias("errors")
        )
        .unionByName(
            asked.where(F.coalesce(F.size("files"), F.lit(0)) <= 0).select(
                "request_id", F.array(F.lit(say.NO_FILES)).alias("errors")
            )
        )
        .withColumn("doc_id", F.lit(None).cast("bigint"))
    )
    sound = placed.where((F.col("_gone") == 0) & (F.col("page_count") >= 1))
    spans = sound.withColumn("s", F.lit(1)).withColumn("e", F.col("page_count"))
    rows = expand(spans, deal=("file_pos",)).select(  # one merge may list a large part of all files
        "request_id",
        "doc_id",
        F.lit("merged.pdf").alias("output_name"),
        F.lit(1).alias("part_no"),
        (F.col("_offset") + F.col("page_no")).cast("int").alias("out_no"),
        "page_no",
    )
    return Outcome(rows, bad.select("request_id", "doc_id", "errors"))
