"""Where things go on a page: page numbers, crop boxes, watermarks, and the plan for rendering pages to pictures.

Page rows carry ``rotation, x1, y1, x2, y2`` (the media box) and options come from the request columns next to them, so
every placement is a projection. Width and height are those of the page as shown: turned by 90 or 270 they swap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.functions import numbers as nu
from pagework.functions import sqltext as sq
from pagework.functions import text as tx
from pagework.operators.manifest import output_name
from pagework.operators.rows import Outcome, each, error_part, join_pages, known_docs, present
from pagework.operators.selection import select_pages

NUMBER_MARGIN = 20
STAMP_DPI = 300


def shown_width() -> Column:
    flat = F.pmod(F.col("rotation"), F.lit(180)) == 0
    return F.when(flat, F.col("x2") - F.col("x1")).otherwise(F.col("y2") - F.col("y1"))


def shown_height() -> Column:
    flat = F.pmod(F.col("rotation"), F.lit(180)) == 0
    return F.when(flat, F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1"))


def page_label(current: Column, total: Column, style: Column) -> Column:
    """Label text in one of five styles; an unknown style means the plain number."""
    return (
        F.when(style == "PageOfTotal", tx.message("Page ", current, " of ", total))
        .when(style == "NumberWithDash", tx.message("-", current, "-"))
        .when(style == "RomanLower", F.lower(nu.roman(current)))
        .when(style == "RomanUpper", nu.roman(current))
        .otherwise(current.cast("string"))
    )


def half_em_width(text: Column, font_size: Column) -> Column:
    """Text width where no font is at hand: half an em per character."""
    return F.length(text) * font_size * 0.5


UNKNOWN_ADVANCE = 500  # of a glyph the table lacks: half an em, in thousandths


def measure_texts(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``text, font_size, width, height`` of the distinct ``text, font_size`` rows of ``texts``.

    ``glyphs`` has one ``glyph, advance`` row per character of a font, in thousandths of an em. Each distinct text is measured once,
    whatever the sizes it is set in; its characters meet the glyphs in a join, which Spark broadcasts where the font is small.
    """
    wanted = texts.where("text is not null and font_size is not null").select("text", "font_size").distinct()
    letters = each(wanted.select("text").distinct(), F.filter(F.split("text", ""), lambda c: c != ""), "glyph")
    advance = F.coalesce("advance", F.lit(UNKNOWN_ADVANCE)).cast("bigint")
    ems = letters.join(glyphs.select("glyph", "advance"), "glyph", "left").groupBy("text").agg((F.sum(advance) / 1000).alias("_em"))
    return wanted.join(ems, "text", "left").select(
        "text",
        "font_size",
        (F.coalesce("_em", F.lit(0.0)) * F.col("font_size")).alias("width"),
        F.col("font_size").cast("double").alias("height"),
    )


def number_pages(
    requests: DataFrame,
    docs: DataFrame,
    pages: DataFrame,
    text_width: Callable[[Column, Column], Column] = half_em_width,
    text_height: Callable[[Column, Column], Column] = lambda text, font_size: font_size.cast("double"),
    text_metrics: DataFrame | None = None,
    glyphs: DataFrame | None = None,
) -> Outcome:
    """Label and its anchor point for every page from ``start_page`` on.

    Requests carry ``position, format, font_size, start_page, start_number``. Text sizes come from the two expressions,
    or from a ``text, font_size, width, height`` table where one is given, or from a font's ``glyphs`` as ``measure_texts`` reads
    them; texts that such a table lacks fall back to the expressions.
    """
    known, errors = known_docs(requests, docs)
    later = f"if(start_page <= page_count, array(named_struct('s', greatest(1, start_page), 'e', page_count)), {sq.no_spans()})"
    rows = join_pages(known.where("page_count >= 1").withColumn("spans", F.expr(later)), pages)
    current = F.col("start_number") + (F.col("page_no") - F.col("start_page"))
    rows = rows.withColumn("label", page_label(current, F.col("page_count"), F.col("format")))
    width, height = text_width(F.col("label"), F.col("font_size")), text_height(F.col("label"), F.col("font_size"))
    if glyphs is not None:
        text_metrics = measure_texts(rows.select(F.col("label").alias("text"), "font_size"), glyphs)
    if text_metrics is not None:
        sizes = text_metrics.select(
            F.col("text").alias("label"), "font_size", F.col("width").alias("_w"), F.col("height").alias("_h")
        )
        rows = rows.join(sizes, ["label", "font_size"], "left")
        width, height = F.coalesce("_w", width), F.coalesce("_h", height)
    page_w, page_h, place = shown_width(), shown_height(), F.col("position")
    x = (
        F.when(place.isin("TopLeft", "BottomLeft"), F.lit(float(NUMBER_MARGIN)))
        .when(place.isin("TopRight", "BottomRight"), page_w - width - NUMBER_MARGIN)
        .otherwise((page_w - width) / 2)
    )
    top = place.isin("TopLeft", "TopCenter", "TopRight")
    y = F.when(top, height + NUMBER_MARGIN).otherwise(page_h - NUMBER_MARGIN)
    labels = rows.select(
        "request_id",
        "doc_id",
        output_name("numbers", F.col("base")).alias("output_name"),
        "page_no",
        "label",
        x.alias("x"),
        y.alias("y"),
    )
    return Outcome(labels, errors)


def crop_selection(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Selection of crop requests: ``pages_range`` all, or ``custom_pages`` whatever the range says; no text, no page."""
    known, errors = known_docs(requests, docs)
    spans = (
        F.when(F.col("pages_range") == "all", F.expr(sq.whole()))
        .when(tx.is_blank(F.col("custom_pages")), F.expr(sq.no_spans()))
        .otherwise(F.expr(sq.crop_spans("custom_pages")))
    )
    return Outcome(known.withColumn("spans", spans), errors)


def crop_pages(requests: DataFrame, docs: DataFrame, pages: DataFrame) -> Outcome:
    """Every page of the output with its crop box, null where the page stays as it is.

    Margins ``m_left, m_bottom, m_right, m_top`` come off the media box; a box that would turn inside out is not set.
    """
    covered = "transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'chosen', true))"
    others = f"transform({sq.complement('spans')}, x -> named_struct('s', x.s, 'e', x.e, 'chosen', false))"
    wanted, errors = crop_selection(requests, docs)
    selection = wanted.withColumn("spans", F.expr(f"concat({covered}, {others})"))
    rows = join_pages(selection, pages, keep=("chosen",))
    x1, y1 = F.col("x1") + F.col("m_left"), F.col("y1") + F.col("m_bottom")
    x2, y2 = F.col("x2") - F.col("m_right"), F.col("y2") - F.col("m_top")
    cropped = F.col("chosen") & (x2 > x1) & (y2 > y1)
    box = {"crop_x1": x1, "crop_y1": y1, "crop_x2": x2, "crop_y2": y2}
    boxes = rows.select(
        "request_id",
        "doc_id",
        output_name("crop", F.col("base")).alias("output_name"),
        "page_no",
        cropped.alias("is_cropped"),
        *[F.when(cropped, value).alias(name) for name, value in box.items()],
    )
    return Outcome(boxes, errors)


def crop_summary(cropped: DataFrame) -> DataFrame:
    return cropped.groupBy("request_id", "doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if("is_cropped").alias("cropped_pages")
    )


def stamp_pixels() -> tuple[Column, Column]:
    """Stamp size in pixels before scaling: from the text at 300 dpi, or the picture's own, turned by ``stamp_turn``."""
    scale = F.lit(STAMP_DPI / 72.0)
    size = F.col("font_size") * scale
    padding = F.floor(size * 0.8).cast("int")
    text_w = F.floor(F.length("text") * F.col("font_size") * scale + padding * 2).cast("int")
    text_h = F.floor(size + padding * 2).cast("int")
    picture = F.col("watermark_type") == "image"
    return nu.turned_box(
        F.when(picture, F.col("image_width")).otherwise(text_w),
        F.when(picture, F.col("image_height")).otherwise(text_h),
        F.col("stamp_turn"),
    )


def stamp_points() -> tuple[Column, Column]:
    """Stamp size in points: text pixels by 72/300, picture pixels by the scale percentage and no dpi step."""
    wide, tall = stamp_pixels()
    picture = F.col("watermark_type") == "image"

    def points(pixels: Column) -> Column:
        return F.when(picture, pixels * (F.col("image_scale") / 100.0)).otherwise(pixels * 72 / STAMP_DPI)

    return points(wide), points(tall)


def stamp_ink() -> list[Column]:
    """Colour channels and opacity of a text stamp."""
    return [nu.colour_channel(F.col("text_color"), i).alias(c) for i, c in enumerate(("red", "green", "blue"))] + [
        F.floor(F.col("opacity") * 255 / 100.0).cast("int").alias("alpha")
    ]


def _stamped(requests: DataFrame, docs: DataFrame, pages: DataFrame) -> Outcome:
    """Pages to stamp, and the requests without a document or, for a text, with a colour that is none."""
    wide, tall = stamp_points()
    selected, missing = select_pages(requests, docs)
    if "text_color" in requests.columns:
        wrong = (F.col("watermark_type") == "text") & ~nu.is_colour(F.col("text_color"))
        said = F.when(wrong, F.concat(F.lit(say.BAD_COLOUR), F.col("text_color")))
        checked = selected.withColumn("errors", present(said))
        missing = missing.unionByName(error_part(checked))
        selected = checked.where(F.size("errors") == 0).drop("errors")
    rows = join_pages(selected.withColumn("_w", wide).withColumn("_h", tall), pages)
    return Outcome(rows.withColumn("_pw", shown_width()).withColumn("_ph", shown_height()), missing)


def _placed(rows: DataFrame, tile: Column, x: Column, y: Column) -> DataFrame:
    return rows.select(
        "request_id",
        "doc_id",
        output_name("watermark", F.col("base")).alias("output_name"),
        "page_no",
        tile.alias("tile_no"),
        x.alias("left"),
        y.alias("top"),
        (x + F.col("_w")).alias("right"),
        (y + F.col("_h")).alias("bottom"),
    )


def place_watermark(requests: DataFrame, docs: DataFrame, pages: DataFrame) -> Outcome:
    """One stamp per selected page: a corner with 5 percent margins, anything else centred; tiled requests left out.

    Requests carry ``mode, custom_pages, start_page, end_page, watermark_type, text, font_size, image_width,
    image_height, image_scale, stamp_turn, position``. Sizes are worked out once per request, before pages are joined.
    """
    rows, errors = _stamped(requests.where(F.col("position") != "Tiled"), docs, pages)
    place, pw, ph, w, h = F.col("position"), F.col("_pw"), F.col("_ph"), F.col("_w"), F.col("_h")
    left, right = place.isin("TopLeft", "BottomLeft"), place.isin("TopRight", "BottomRight")
    top, bottom = place.isin("TopLeft", "TopRight"), place.isin("BottomLeft", "BottomRight")
    x = F.when(left, pw * 0.05).when(right, pw - w - pw * 0.05).otherwise((pw - w) / 2)
    y = F.when(top, ph * 0.05).when(bottom, ph - h - ph * 0.05).otherwise((ph - h) / 2)
    return Outcome(_placed(rows, F.lit(1), x, y), errors)


def place_tiled(requests: DataFrame, docs: DataFrame, pages: DataFrame) -> Outcome:
    """Three stamps per selected page of tiled requests: centred across, at a half, a sixth and five sixths of the height."""
    rows, errors = _stamped(requests.where(F.col("position") == "Tiled"), docs, pages)
    half = F.col("_ph") / 2
    centres = F.array(half, half / 3, half * 5 / 3)
    tiles = each(rows, centres, "_centre", "_tile")
    x = F.col("_pw") / 2 - F.col("_w") / 2
    return Outcome(_placed(tiles, F.col("_tile") + 1, x, F.col("_centre") - F.col("_h") / 2), errors)


def watermark_summary(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Pages of the document and pages stamped, counted on the request row without listing pages."""
    selected, errors = select_pages(requests, docs)
    counted = F.expr(sq.count("spans")).alias("watermarked_pages")
    return Outcome(selected.select("request_id", "doc_id", "page_count", counted), errors)


def render_plan(pages: DataFrame, dpi: int | Column, fmt: str | Column, padded: bool | Column = True) -> DataFrame:
    """One picture per page with its name and pixel size, cut to whole pixels. A projection of the page table."""
    dpi, fmt, padded = (F.lit(v) if not isinstance(v, Column) else v for v in (dpi, fmt, padded))
    zoom = dpi / 72.0
    number = F.when(padded, F.concat(F.lit("_page_"), F.format_string("%03d", "page_no"))).otherwise(
        F.concat(F.lit("_"), F.col("page_no").cast("string"))
    )
    return pages.select(
        "doc_id",
        "page_no",
        F.concat(F.col("base"), number, F.lit("."), fmt).alias("image_name"),
        F.floor(shown_width() * zoom).cast("int").alias("pixel_width"),
        F.floor(shown_height() * zoom).cast("int").alias("pixel_height"),
    )
