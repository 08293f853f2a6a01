"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import labels

# All Unicode blanks; the last one is U+3000.
_BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot; leading dots never start a suffix."""
    return F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(?s)^.+(\.[^.]*)$", 1)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _before_last(text: Column, mark: str) -> Column:
    return F.left(text, F.length(text) - F.length(F.substring_index(text, mark, -1)) - 1)


def without_extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), _before_last(name, ".")).otherwise(name)


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), _before_last(path, "/")).otherwise("")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def segment(path: Column, position: int, default: str = labels.UNKNOWN) -> Column:
    """Non-empty path segment at ``position``; the file name counts as one."""
    return F.coalesce(F.get(segments(path), position), F.lit(default))


def depth(directory: Column) -> Column:
    return F.size(segments(directory)).cast("long")


def size_class(size: Column) -> Column:
    return (
        F.when(size < labels.MEDIUM_FROM, labels.SMALL)
        .when(size < labels.LARGE_FROM, labels.MEDIUM)
        .otherwise(labels.LARGE)
    )


def megabytes(size: Column) -> Column:
    """Bytes as binary megabytes, two decimals, ties to even (decimal, so exact)."""
    return F.bround(size.cast("decimal(20,0)") / F.lit(1048576), 2)


def size_label(size: Column) -> Column:
    """``"1.5 MB"``: at least one decimal is kept, as a float would print."""
    return F.concat(F.regexp_replace(megabytes(size).cast("string"), "0$", ""), F.lit(" MB"))


def spaced_thousands(number: Column) -> Column:
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def score_label(score: Column) -> Column:
    """Three decimals, rounded from the exact binary value, ties to even (0.6435 is stored below its tie: 0.643).

    The score is split in two parts whose products with 1000 are exact doubles.
    """
    size = F.abs(score)
    high = F.floor(size * 2**26) / F.lit(2.0**26)
    thousands, rest = high * 1000, (size - high) * 1000
    whole = F.floor(thousands)
    to_tie = F.lit(0.5) - (thousands - whole)
    up = (rest > to_tie) | ((rest == to_tie) & (whole % 2 == 1))
    units = whole + up.cast("int")
    digits = F.concat(
        F.when(score < 0, "-").otherwise(""),
        F.floor(units / 1000).cast("string"),
        F.lit("."),
        F.lpad((units % 1000).cast("string"), 3, "0"),
    )
    return F.when(score.isNull(), F.lit(labels.NO_SCORE)).otherwise(digits)
