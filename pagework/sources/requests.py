"""Request tables: one JSON object per request, fixed schemas, defaults filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagework.functions.messages import UNREADABLE
from pagework.operators.rows import Outcome

_HEAD = "request_id BIGINT, doc_id BIGINT, file_path STRING"

# Fields and defaults of each tool's request.
FIELDS = {
    "split": "method STRING, page_ranges ARRAY<STRING>, split_points ARRAY<INT>, page_interval INT, output_format STRING",
    "remove": "pages ARRAY<INT>, page_ranges ARRAY<STRING>, even BOOLEAN, odd BOOLEAN, nth INT, start INT",
    "organize": "page_order ARRAY<STRUCT<page_number: INT, rotation: INT>>",
    "merge": "files ARRAY<STRING>",
    "numbers": "position STRING, format STRING, font_size INT, start_page INT, start_number INT",
    "crop": "pages_range STRING, custom_pages STRING, m_top DOUBLE, m_right DOUBLE, m_bottom DOUBLE, m_left DOUBLE, "
    "current_page INT",
    "watermark": "watermark_type STRING, text STRING, position STRING, stamp_turn INT, opacity INT, font_size INT, "
    "text_color STRING, start_page INT, end_page INT, mode STRING, custom_pages STRING, image_path STRING, "
    "image_scale INT",
    "render": "dpi INT, image_format STRING, padded BOOLEAN",
    "compress": "quality STRING, custom_quality INT, remove_metadata BOOLEAN, remove_unused BOOLEAN",
    "images": "mode STRING, pages ARRAY<INT>, page_ranges ARRAY<STRING>",
    "metadata": "operation STRING, metadata STRUCT<title: STRING, author: STRING, subject: STRING, keywords: STRING, "
    "creator: STRING, producer: STRING>",
    "lock": "operation STRING, password STRING, encryption_level INT",
    "unlock": "operation STRING, password STRING",
}
DEFAULTS = {
    "split": {"method": "ByPageRanges", "output_format": "Zip"},
    "remove": {"even": False, "odd": False},
    "numbers": {"position": "BottomCenter", "format": "Number", "font_size": 12, "start_page": 1, "start_number": 1},
    "crop": {"pages_range": "all", "m_top": 0.0, "m_right": 0.0, "m_bottom": 0.0, "m_left": 0.0},
    "watermark": {
        "watermark_type": "text", "text": "CONFIDENTIAL", "position": "Center", "stamp_turn": 45, "opacity": 60,
        "font_size": 36, "text_color": "#3498db", "start_page": 1, "end_page": 0, "mode": "all", "custom_pages": "",
        "image_scale": 50,
    },
    "render": {"dpi": 150, "image_format": "jpg", "padded": True},
    "compress": {"quality": "Medium", "remove_metadata": False, "remove_unused": True},
    "images": {"mode": "extract"},
    "metadata": {"operation": ""},
    "lock": {"operation": "", "encryption_level": 128},
    "unlock": {"operation": ""},
}


def request_schema(tool: str) -> T.StructType:
    return T.StructType.fromDDL(f"{_HEAD}, {FIELDS[tool]}")


def with_defaults(requests: DataFrame, tool: str) -> DataFrame:
    """Nulls replaced by the tool's defaults."""
    defaults = DEFAULTS.get(tool, {})
    filled = requests
    if tool == "organize":
        turned = F.transform(
            "page_order",
            lambda x: F.struct(
                x["page_number"].alias("page_number"), F.coalesce(x["rotation"], F.lit(0)).alias("rotation")
            ),
        )
        filled = filled.withColumn("page_order", turned)
    return filled.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def read_requests(spark: SparkSession, path: str, tool: str) -> Outcome:
    """Requests of one tool from JSON lines, defaults filled in where a field is absent.

    A line that is no JSON object, and one with a value of another type, is an error row with the line itself. Its number is
    known where that could be read.
    """
    schema = request_schema(tool).add("_line", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_line"}).alias("_r"), "value")
    broken = F.col("_r._line").isNotNull() | F.col("_r").isNull()
    errors = read.where(broken).select(
        "_r.request_id", "_r.doc_id", F.array(F.concat(F.lit(UNREADABLE), F.col("value"))).alias("errors")
    )
    return Outcome(with_defaults(read.where(~broken).select("_r.*").drop("_line"), tool), errors)
