"""Listings stored in the order of their pages.

``store`` numbers the rows of a listing and writes them by number, in files of bounded length. A page is then a range of
numbers, which the files' footers and page indexes narrow down: any page reads about as much as the first, without the
pages before it. Pages of a further selection are looked for from a number on, in ranges that grow until the page is full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinfold import labels
from kinfold.operators.numbering import number_rows

POSITION = "position"
FILE_ROWS = 1 << 20
#: Each range is this many times longer than the one before it.
GROWTH = 4


def store(listing: DataFrame, order: list[str], location: str, file_rows: int = FILE_ROWS) -> None:
    """Writes a listing by its place in ``order``, which must be unique; any columns but ``position``."""
    numbered = number_rows(listing, order, POSITION)
    ranged = numbered.repartitionByRange(POSITION).sortWithinPartitions(POSITION)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(location)


def stored(spark: SparkSession, location: str, schema: StructType) -> DataFrame:
    """A stored listing with ``position``; ``schema`` is the listing's own."""
    return spark.read.schema(StructType([*schema, StructField(POSITION, LongType())])).parquet(location)


def page(table: DataFrame, number: int, rows: int = labels.PAGE_ROWS) -> DataFrame:
    """Page ``number`` from 0 on; empty beyond the last."""
    if number < 0 or rows < 1:
        raise ValueError("pages are numbered from 0 on and hold at least one row")
    return _between(table, number * rows, (number + 1) * rows).orderBy(POSITION)


def page_from(
    table: DataFrame, start: int, select: Callable[[DataFrame], DataFrame], rows: int = labels.PAGE_ROWS
) -> DataFrame:
    """The first ``rows`` rows that ``select`` keeps from place ``start`` on; the next page starts behind the last one's place.

    Only counts reach the driver. Where few rows are kept, the ranges grow to the listing's end, which is a scan in a
    number of steps that grows with the logarithm of its length.
    """
    if start < 0 or rows < 1:
        raise ValueError("a page starts at 0 or later and holds at least one row")
    end, total, width, found = start, table.count(), rows * GROWTH, 0
    while end < total and found < rows:
        found += select(_between(table, end, end + width)).count()
        end, width = end + width, width * GROWTH
    return select(_between(table, start, end)).orderBy(POSITION).limit(rows)


def _between(table: DataFrame, start: int, end: int) -> DataFrame:
    return table.filter((F.col(POSITION) >= start) & (F.col(POSITION) < end))
