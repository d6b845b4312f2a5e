"""Images embedded in pages: listing, extracting, removing, shrinking, deduplicating, and what compression gained.

Image rows are ``doc_id, page_no, img_index, xref, width, height, n_components, has_alpha``; ``xref`` names the image
object, which several pages may share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import numbers as nu
from pagework.functions import sqltext as sq
from pagework.operators.rows import block_of, each, join_pages, spread

# Quality presets, and the limits by quality: (up to quality, longest side, JPEG quality).
PRESETS = {"Low": 50, "Medium": 75, "High": 90}
DEFAULT_QUALITY = 75
TIERS = [(10, 400, 5), (30, 600, 10), (50, 800, 20)]
TOP_TIER = (1024, 30)
SMALL_AREA = 1000
SHRINK = 0.8


def extractable_images(selection: DataFrame, images: DataFrame, fmt: Column | None = None) -> DataFrame:
    """Images on selected pages with fewer than four colour components, and the file each goes to.

    ``img_index`` counts all images of the page, also the ones left out.
    """
    fmt = F.lit("png") if fmt is None else fmt
    colours = F.col("n_components") - F.when(F.col("has_alpha"), 1).otherwise(0)
    extension = F.when(F.lower(fmt) == "jpg", F.lit("jpg")).otherwise(F.lit("png"))
    name = F.format_string("page_%d_image_%04d.%s", "page_no", "img_index", extension)
    return (
        join_pages(selection.select("request_id", "doc_id", "spans"), images)
        .where(colours < 4)
        .select("request_id", "doc_id", "page_no", "img_index", "xref", "width", "height", name.alias("image_name"))
    )


def extraction_summary(selection: DataFrame, images: DataFrame) -> DataFrame:
    """Images extracted and pages looked at per request; none found is a result of 0."""
    found = extractable_images(selection, images).groupBy("request_id").agg(F.count("*").alias("_found"))
    return selection.join(found, "request_id", "left").select(
        "request_id",
        "doc_id",
        F.coalesce("_found", F.lit(0)).cast("int").alias("extracted_count"),
        F.expr(sq.count("spans")).alias("processed_pages"),
    )


def remove_images(selection: DataFrame, images: DataFrame) -> DataFrame:
    """Images that are still there once the selected pages' image objects are deleted, on whatever page they are used.

    An object's uses are gathered by block of pages, so one that stands on every page of a long document is many short rows;
    whether any of them is selected is then known from one row per block.
    """
    keys = ["request_id", "doc_id", "xref"]
    asked = _with_choice(selection, images).select(*keys, block_of(F.col("page_no")).alias("_block"), "page_no", "img_index", "chosen")
    uses = (
        spread(asked, *keys, "_block")
        .groupBy(*keys, "_block")
        .agg(F.bool_or("chosen").alias("_chosen"), F.collect_list(F.struct("page_no", "img_index")).alias("_uses"))
    )
    anywhere = Window.partitionBy(*keys)
    left = uses.withColumn("_gone", F.max("_chosen").over(anywhere)).where("not _gone")
    return each(left, F.col("_uses"), "_use").select("request_id", "doc_id", "_use.page_no", "_use.img_index", "xref")


def removal_summary(selection: DataFrame, images: DataFrame) -> DataFrame:
    """Image objects removed and pages looked at per request; an object used on several pages is removed once."""
    chosen = join_pages(selection.select("request_id", "doc_id", "spans"), images.select("doc_id", "page_no", "xref"))
    removed = chosen.select("request_id", "xref").distinct().groupBy("request_id").agg(F.count("*").alias("_removed"))
    return selection.join(removed, "request_id", "left").select(
        "request_id",
        "doc_id",
        F.coalesce("_removed", F.lit(0)).cast("int").alias("removed_count"),
        F.expr(sq.count("spans")).alias("processed_pages"),
    )


def _with_choice(selection: DataFrame, images: DataFrame) -> DataFrame:
    """All images of each request's document, and whether their page is ``chosen``: one join for both."""
    covered = "transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'chosen', true))"
    others = f"transform({sq.complement('spans')}, x -> named_struct('s', x.s, 'e', x.e, 'chosen', false))"
    both = selection.select("request_id", "doc_id", F.expr(f"concat({covered}, {others})").alias("spans"))
    return join_pages(both, images, keep=("chosen",))


def preset_quality(preset: Column, custom: Column) -> Column:
    quality = F.when(preset == "Custom", F.coalesce(custom, F.lit(DEFAULT_QUALITY)))
    for name, value in PRESETS.items():
        quality = quality.when(preset == name, value)
    return quality.otherwise(DEFAULT_QUALITY)


def recompress_plan(images: DataFrame, quality: Column) -> DataFrame:
    """New size and JPEG quality of every image; under 1000 pixels it stays.

    A projection: an object used on several pages gets the same plan on each, which is planning it once.
    """
    longest = jpeg = F
    for upto, side, q in TIERS:
        longest, jpeg = longest.when(F.col("_quality") <= upto, side), jpeg.when(F.col("_quality") <= upto, q)
    width, height, limit = F.col("width"), F.col("height"), F.col("_longest")
    fits = (width <= limit) & (height <= limit)
    # An image with a side of 0, now or once it is shrunk, is left alone as well.
    shrinks = (width * height >= SMALL_AREA) & (F.col("_w") > 0) & (F.col("_h") > 0)
    planned = (
        images.withColumn("_quality", quality)
        .withColumn("_longest", longest.otherwise(TOP_TIER[0]))
        .withColumn("_factor", F.when(fits, F.lit(SHRINK)).otherwise(F.least(F.try_divide(limit, width), F.try_divide(limit, height))))
        .withColumns({"_w": F.floor(width * F.col("_factor")), "_h": F.floor(height * F.col("_factor"))})
        .withColumn("_shrinks", shrinks)
    )
    return planned.select(
        *images.columns,
        F.when(F.col("_shrinks"), "recompress").otherwise("keep").alias("action"),
        F.when(F.col("_shrinks"), F.col("_w")).otherwise(width).cast("bigint").alias("new_width"),
        F.when(F.col("_shrinks"), F.col("_h")).otherwise(height).cast("bigint").alias("new_height"),
        F.when(F.col("_shrinks"), jpeg.otherwise(F.greatest(F.lit(TOP_TIER[1]), F.col("_quality"))))
        .cast("int")
        .alias("jpeg_quality"),
    )


def object_plan(plan: DataFrame) -> DataFrame:
    """One row per image object with the pages that use it; counted before the shuffle as well as after."""
    return plan.groupBy("doc_id", "xref", "action", "new_width", "new_height", "jpeg_quality").agg(
        F.min("page_no").alias("first_page"), F.count("*").alias("uses")
    )


def dedupe_images_by_dims(plan: DataFrame) -> DataFrame:
    """Marks images whose new size was met before in the same document, in page order.

    The first image of each size is found by an aggregate, which combines before the shuffle; the rows themselves are
    shuffled once, to meet it, and a size that many images have is split by the join. Rows equal in page and index are one
    image.
    """
    size = ["doc_id", "new_width", "new_height"]
    firsts = plan.groupBy(*size).agg(F.min(F.struct("page_no", "img_index")).alias("_first"))
    same = " and ".join(f"p.{c} <=> f.{c}" for c in size)
    return plan.alias("p").join(firsts.alias("f"), F.expr(same)).select(
        "p.*", (F.struct("p.page_no", "p.img_index") > F.col("f._first")).alias("is_duplicate")
    )


def compression_outcome(sizes: DataFrame) -> DataFrame:
    """Final size and saving in percent of ``original_size, compressed_size``; a result that grew is thrown away."""
    original, compressed = F.col("original_size"), F.col("compressed_size")
    grew = compressed >= original
    ratio = F.when(grew | (original <= 0), F.lit(0.0)).otherwise(
        F.rint((original - compressed) / original * 100 * 100) / 100  # half-even at two decimals
    )
    final = F.when(grew, original).otherwise(compressed)
    return sizes.select(
        "*",
        grew.alias("kept_original"),
        final.alias("final_size"),
        ratio.alias("compression_ratio"),
        nu.human_size(original).alias("original_text"),
        nu.human_size(final).alias("final_text"),
        nu.megabytes(original).alias("original_mb"),
    )
