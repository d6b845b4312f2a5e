"""White space and file names in the flavours the page tools use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each language counts as white space at the ends of a text.
DOTNET_BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PYTHON_BLANKS = DOTNET_BLANKS + "\x1c\x1d\x1e\x1f"
SCRIPT_BLANKS = DOTNET_BLANKS.replace("\x85", "") + "\ufeff"


def strip(text: Column, blanks: str = DOTNET_BLANKS) -> Column:
    return F.trim(text, F.lit(blanks))


def blank_to_null(text: Column, blanks: str = DOTNET_BLANKS) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(text, blanks), F.lit(""))


def is_blank(text: Column, blanks: str = DOTNET_BLANKS) -> Column:
    return F.coalesce(strip(text, blanks) == "", F.lit(True))


def base_name(path: Column) -> Column:
    """Last part of a path written with either slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def message(*parts: str | Column) -> Column:
    """Text put together from literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
