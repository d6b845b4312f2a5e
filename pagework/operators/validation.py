"""Request checks per tool, as an array of messages on the request row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.functions import messages as say
from pagework.functions import sqltext as sq
from pagework.operators.manifest import listed_files

# Limits and accepted names.
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".bmp"]
IMAGE_BYTES = 10 * 1024 * 1024
RENDER_FORMATS = ["jpg", "jpeg", "png"]
SPLIT_METHODS = ["ByPageRanges", "AtSpecificPages", "EveryNPages", "ExtractAllPages"]
MARGINS = {"m_top": "Top", "m_right": "Right", "m_bottom": "Bottom", "m_left": "Left"}


def _blank(x: str, blanks: str = sq.DOTNET_BLANKS) -> str:
    return f"coalesce({sq.strip(x, blanks)} = '', true)"


def _empty(x: str) -> str:
    return f"coalesce(size({x}) <= 0, true)"


def _among(x: str, names: list[str]) -> str:
    return f"coalesce({x} in ({', '.join(repr(n) for n in names)}), false)"


def _outside(x: str, low: int, high: int) -> str:
    return f"not coalesce({x} between {low} and {high}, false)"


def _path(unset: str, said: str) -> list[tuple[str, str]]:
    return [
        (unset, f"'{said}'"),
        (f"not ({unset}) and not file_exists", f"concat('{say.FILE_NOT_FOUND}', file_path)"),
    ]


# A path of blanks counts as given for the tools that only ask for one, and as missing for the others.
_BODY = _path("coalesce(file_path, '') = ''", "Invalid request. File path is required.")
_BRIEF = _path(_blank("file_path"), "File path is required.")
_PAGE_RANGE = "' is out of range (1-', page_count, ')'"
_WRONG_PAGE = "filter(pages, p -> p not between 1 and page_count)"
_WRONG_STEP = "filter(page_order, x -> x.page_number not between 1 and page_count)"
_WRONG_TURN = "filter(page_order, x -> x.rotation % 90 <> 0)"
_EXTENSION = r"lower(regexp_extract(image_name, '(\\.[^.\\\\/]*)$', 1))"
_UNSET = (
    "filter(array("
    + ", ".join(f"if(coalesce({sq.leading_digits(m)}, '') = '', '{label}', null)" for m, label in MARGINS.items())
    + "), x -> x is not null)"
)


def _password(tool: str, needed: str) -> list[tuple[str, str]]:
    return [
        *_BRIEF,
        (f"coalesce(lower(operation) <> '{tool}', true)", f"'Operation must be \\'{tool}\\' for this endpoint.'"),
        ("not has_options", f"'{tool.title()} options are required for {tool}ing operation'"),
        (f"has_options and {_blank('password')}", f"'{needed}'"),
    ]


# The messages. Per tool: (condition that makes the request bad, message), in the order they are checked.
RULES: dict[str, list[tuple[str, str]]] = {
    "split": [
        *_BODY,
        (f"method = 'ByPageRanges' and {_empty('page_ranges')}", f"'{say.NO_RANGES}'"),
        (f"method = 'AtSpecificPages' and {_empty('split_points')}", f"'{say.NO_POINTS}'"),
        ("method = 'EveryNPages' and coalesce(page_interval, 0) < 1", f"'{say.BAD_INTERVAL}'"),
        (f"not {_among('method', SPLIT_METHODS)}", "'Invalid split method'"),
    ],
    "remove": [
        *_BODY,
        ("not has_options", "'Remove options are required.'"),
        (
            f"has_options and {_empty('pages')} and {_empty('page_ranges')} and not coalesce(even, false) and not coalesce(odd, false)"
            " and nth is null",
            f"'{say.NO_CRITERION}'",
        ),
        (f"has_options and size({_WRONG_PAGE}) > 0", f"concat('Page number ', get({_WRONG_PAGE}, 0), {_PAGE_RANGE})"),
    ],
    "organize": [
        *_BODY,
        ("not has_options", "'Organize options are required.'"),
        (f"has_options and {_empty('page_order')}", f"'{say.NO_ORDER}'"),
        (f"has_options and size({_WRONG_STEP}) > 0", f"concat('Page number ', get({_WRONG_STEP}, 0).page_number, {_PAGE_RANGE})"),
        (
            f"has_options and size({_WRONG_TURN}) > 0",
            f"concat('{say.BAD_TURN}', get({_WRONG_TURN}, 0).rotation)",
        ),
    ],
    "merge": [
        ("files is null", f"'{say.NO_FILES}'"),
        ("missing_file is not null", f"concat('{say.FILE_NOT_FOUND}', missing_file)"),
    ],
    "numbers": [*_BRIEF, (_outside("font_size", 8, 72), "'Font size must be between 8 and 72.'")],
    "watermark": [
        *_BRIEF,
        (_outside("opacity", 1, 100), "'Opacity must be between 1 and 100.'"),
        (_outside("font_size", 8, 144), "'Font size must be between 8 and 144.'"),
    ],
    "image_watermark": [
        *_BRIEF,
        (_outside("opacity", 1, 100), "'Opacity must be between 1 and 100.'"),
        ("coalesce(image_size, 0) <= 0", "'Image file is required for image watermarks.'"),
        (
            f"image_size > 0 and not {_among(_EXTENSION, IMAGE_EXTENSIONS)}",
            "'Invalid image format. Supported formats: PNG, JPG, JPEG, GIF, BMP'",
        ),
        (f"image_size > {IMAGE_BYTES}", "'Image file size must be less than 10MB.'"),
    ],
    "render": [
        *_BRIEF,
        (_outside("dpi", 1, 600), "'DPI must be between 1 and 600.'"),
        (f"not {_among('lower(image_format)', RENDER_FORMATS)}", "'Format must be \\'jpg\\' or \\'png\\'.'"),
    ],
    "compress": [
        *_BODY,
        ("not has_options", "'Compress options are required.'"),
        (
            f"has_options and quality = 'Custom' and {_outside('custom_quality', 1, 100)}",
            "'Custom quality must be between 1 and 100.'",
        ),
    ],
    "metadata": [
        *_BRIEF,
        (_blank("operation"), "'Operation is required (read or write).'"),
        (
            f"not {_blank('operation')} and lower(operation) not in ('read', 'write')",
            "concat('Invalid operation: ', operation)",
        ),
        ("lower(operation) = 'write' and not has_options", f"'{say.NO_METADATA}'"),
    ],
    "images": [
        (f"{_blank('file_path')} or not file_exists", "'Invalid file path.'"),
        ("not has_options", "'Options are required.'"),
    ],
    "lock": [
        *_password("lock", "Open password is required for locking PDF"),
        (
            f"has_options and not {_blank('password')} and length(password) < 3",
            "'Open password must be at least 3 characters long'",
        ),
    ],
    "unlock": _password("unlock", "Password is required for unlocking PDF"),
    "crop": [
        *_BRIEF,
        (f"size({_UNSET}) > 0", f"concat('Please enter valid margin values for: ', array_join({_UNSET}, ', '))"),
        (
            f"pages_range = 'custom' and {_blank('custom_pages', sq.JS)}",
            "'Please enter a custom page range or select \"All Pages\".'",
        ),
    ],
}


def _messages(tool: str) -> str:
    said = ", ".join(f"if({bad}, {text}, null)" for bad, text in RULES[tool])
    return f"filter(array({said}), x -> x is not null)"


def first_missing_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``request_id, missing_file``: the first file of each list that does not exist."""
    return (
        listed_files(requests, files.select("file_path", F.lit(True).alias("_there")))
        .where(F.col("_there").isNull())
        .groupBy("request_id")
        .agg(F.min_by(F.coalesce("file_path", F.lit("")), "file_pos").alias("missing_file"))
    )


def validate_requests(requests: DataFrame, docs: DataFrame, tool: str | None = None) -> DataFrame:
    """Requests with ``errors ARRAY<STRING>``, in the order the checks are made. ``tool`` restricts to one tool.

    ``docs`` gives existing paths and page counts. Passwords are checked here and dropped from the result.
    """
    asked = requests if tool is None else requests.where(F.col("tool") == tool)
    tools = list(RULES) if tool is None else [tool]
    known = asked.join(
        docs.select("file_path", "page_count", F.lit(True).alias("_there")), "file_path", "left"
    ).withColumn("file_exists", F.col("_there").isNotNull())
    if "merge" in tools:
        lists = asked.where(F.col("tool") == "merge")
        known = known.join(first_missing_files(lists, docs), "request_id", "left")
    cases = " ".join(f"when '{name}' then {_messages(name)}" for name in tools)
    checked = known.withColumn("errors", F.expr(f"case tool {cases} else array(concat('Unknown tool: ', tool)) end"))
    return checked.drop("_there", "file_exists", "missing_file", "page_count", "password")
