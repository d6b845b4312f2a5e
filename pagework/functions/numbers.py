"""Rotation, Roman numerals, sizes, colours and rotated boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numeral steps.
ROMAN = [
    (1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"),
    (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"),
]
SIZE_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB"]
DEFAULT_COLOUR = (52, 152, 219)


def quarter_turn(degrees: Column) -> Column:
    """Any whole-degree rotation brought into 0..359."""
    return F.pmod(degrees, F.lit(360)).cast("int")


def roman(number: Column) -> Column:
    """Roman numeral for 1 to 3999, decimal digits outside. Each decimal place is looked up on its own."""

    def place(unit: int) -> list[str]:
        signs = dict(ROMAN)
        one, five, ten = signs[unit], signs.get(5 * unit, ""), signs.get(10 * unit, "")
        return ["", one, one * 2, one * 3, signs.get(4 * unit, one * 4), five, five + one, five + one * 2,
                five + one * 3, signs.get(9 * unit, ten)]

    def digit(unit: int) -> Column:
        table = F.array(*[F.lit(x) for x in place(unit)])
        return F.get(table, F.pmod(F.floor(number / unit), F.lit(10)).cast("int"))

    return F.when(number.between(1, 3999), F.concat(*[digit(u) for u in (1000, 100, 10, 1)])).otherwise(
        number.cast("string")
    )


def two_decimals(value: Column) -> Column:
    """Half-up rounding at two decimals, as ``floor(x*100 + 0.5) / 100``."""
    return F.floor(value * 100 + 0.5) / 100.0


def human_size(size: Column) -> Column:
    """``0 Bytes``, else the size in the largest unit, Bytes to EB, that it fills."""
    step = F
    for unit in range(1, len(SIZE_UNITS)):
        step = step.when(size < 1024**unit, unit - 1)
    step = step.otherwise(len(SIZE_UNITS) - 1)
    value = two_decimals(size / F.pow(F.lit(1024.0), step))
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.get(F.array(*[F.lit(u) for u in SIZE_UNITS]), step)
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(F.concat(shown, F.lit(" "), unit))


def megabytes(size: Column) -> Column:
    """Megabytes of a whole number of bytes at two decimals, half-even; ``format_string`` rounds ties up. The part behind the point
    is a multiple of 2**-20, so its hundredths are exact."""
    value = F.abs(size.cast("double")) / 1048576.0
    whole = F.floor(value)
    cents = F.rint((value - whole) * 100).cast("bigint")
    text = F.concat((whole + F.when(cents == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.concat(F.when(size < 0, "-").otherwise(""), text)


def colour_channel(colour: Column, index: int) -> Column:
    """Channel 0, 1 or 2 of ``#rrggbb``, null where a text with ``#`` has no such digits; one without means the default."""
    code = F.conv(F.substring(colour, 2 + 2 * index, 2), 16, 10).cast("int")
    return F.when(is_colour(colour) & colour.startswith("#"), code).when(is_colour(colour), DEFAULT_COLOUR[index])


def is_colour(colour: Column) -> Column:
    return F.coalesce(~colour.startswith("#") | colour.rlike("^#[0-9a-fA-F]{6}"), F.lit(True))


def turned_box(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Whole-pixel box that holds a ``width`` by ``height`` picture turned about its centre."""
    turn = F.pmod(degrees, F.lit(360))
    cos = F.abs(F.round(F.cos(F.radians(turn)), 15))
    sin = F.abs(F.round(F.sin(F.radians(turn)), 15))

    def side(length: Column, reach: Column) -> Column:
        return (F.ceil(length / 2.0 + reach / 2.0) - F.floor(length / 2.0 - reach / 2.0)).cast("int")

    wide = side(width, width * cos + height * sin)
    tall = side(height, width * sin + height * cos)

    def pick(straight: Column, turned: Column, other: Column) -> Column:
        return F.when(turn % 180 == 0, straight).when(turn % 90 == 0, turned).otherwise(other)

    return pick(width, height, wide), pick(height, width, tall)
