"""Search over names and paths by trigrams.

An index of a stage is two tables. ``rows`` has the stage in the order of its paths, numbered and cut into parts, one folder
each. ``postings`` has, for each trigram of a lower-cased name or path, the numbers of the rows with it: one list per
chunk of ``CHUNK`` numbers, so a trigram of all rows is many short lists and not a long one; they are sorted by trigram, so a look-up reads
the files' footers and few lists.

A search derives the trigrams that every hit must have, from a literal or from what a regular expression needs literally. It
intersects the lists of the rarest of them, reads only the parts with candidates, and checks these with the very filter of
``listings.search``. A term that needs no trigram is a scan of all rows, by the same filter. Either way the result is whole.
"""

from __future__ import annotations

import re
from re import _constants as codes
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.listings import search
from kinfold.operators.numbering import number_rows

FIELDS = ["name_key", "path"]
CHUNK = 1 << 16
PART_ROWS = 1 << 20
#: Lists to intersect; further ones would drop few candidates that the filter drops anyway.
RAREST = 3
_SETTINGS = "part_rows long, chunk long, columns string"
_POSTINGS = "gram string, field string, chunk long, n long, places array<int>"


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _literals(tokens) -> list[str]:
    """Strings that every match of a parsed expression has."""
    out, run = [], ""
    for code, value in tokens:
        if code is codes.LITERAL:
            run += chr(value)
            continue
        inner = []
        if code is codes.SUBPATTERN:
            inner = _literals(value[-1])
        elif code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _literals(value[-1])
        if code is not codes.AT:
            out += [run, *inner]
            run = ""
    return [text for text in [*out, run] if text]


def required_grams(term: str, mode: str = "regex") -> set[str]:
    """Trigrams of every row that ``search`` finds; none where a term tells of none.

    Expressions are Java's. Those that Python reads otherwise, or not at all, count as telling of none: special groups,
    flags, quotations, and escapes other than of marks and the common classes.
    """
    term = term.lower()
    if mode == "literal":
        return _grams(term)
    if re.search(r"\(\?|\\[^dswb\W]|\\[^\x00-\x7F]|&&|\[\^?\]|\[[^\]]*\[", term):
        return set()
    try:
        tokens = parser.parse(term)
    except (re.error, OverflowError, RecursionError):
        return set()
    return {gram for text in _literals(tokens) for gram in _grams(text)}


def _trigrams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    places = F.sequence(F.lit(1), F.length(text) - 2)
    grams = F.transform(places, lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) > 2, F.array_distinct(grams))


def build(rows: DataFrame, location: str, part_rows: int = PART_ROWS, chunk: int = CHUNK) -> None:
    """Writes the index of a stage with distinct paths."""
    spark = rows.sparkSession
    numbered = number_rows(rows, ["path"], "row_no").withColumn("part", F.floor(F.col("row_no") / part_rows))
    spread = numbered.repartitionByRange("part", "row_no").sortWithinPartitions("part", "row_no")
    spread.write.mode("overwrite").partitionBy("part").parquet(f"{location}/rows")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    settings = [(part_rows, chunk, ", ".join([*kinds, "row_no long", "part long"]))]
    spark.createDataFrame(settings, _SETTINGS).write.mode("overwrite").parquet(f"{location}/settings")
    stored = _rows(spark, location)
    fields = [F.struct(F.lit(f).alias("field"), _trigrams(F.lower(F.col(f))).alias("grams")) for f in FIELDS]
    grams = stored.select("row_no", F.inline(F.array(*fields))).select("row_no", "field", F.explode("grams").alias("gram"))
    chunked = grams.groupBy("gram", "field", F.floor(F.col("row_no") / chunk).alias("chunk"))
    lists = chunked.agg(F.count("*").alias("n"), F.sort_array(F.collect_list((F.col("row_no") % chunk).cast("int"))).alias("places"))
    ordered = lists.repartitionByRange("gram", "field", "chunk").sortWithinPartitions("gram", "field", "chunk")
    ordered.write.mode("overwrite").parquet(f"{location}/postings")


def _settings(spark: SparkSession, location: str) -> Row:
    return spark.read.schema(_SETTINGS).parquet(f"{location}/settings").first()


def _rows(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(_settings(spark, location).columns).parquet(f"{location}/rows")


def candidates(spark: SparkSession, location: str, grams: set[str]) -> DataFrame:
    """row_no: rows that have all the trigrams in one field, going by the rarest ones."""
    chunk = _settings(spark, location).chunk
    postings = spark.read.schema(_POSTINGS).parquet(f"{location}/postings").filter(F.col("gram").isin(sorted(grams)))
    # One row per trigram and field reaches the driver; a term has few.
    sizes = postings.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()
    found = None
    for field in FIELDS:
        have = sorted((row.n, row.gram) for row in sizes if row.field == field)
        if len(have) < len(grams):
            continue
        rarest = [gram for _, gram in have[:RAREST]]
        lists = postings.filter((F.col("field") == field) & F.col("gram").isin(rarest))
        places = lists.select("chunk", F.explode("places").alias("place"))
        own = places.groupBy((F.col("chunk") * chunk + F.col("place")).alias("row_no")).agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("row_no")
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "row_no long") if found is None else found.distinct()


def indexed_search(spark: SparkSession, location: str, term: str | None, mode: str = "regex") -> DataFrame:
    """The rows of the indexed stage that ``listings.search`` would find."""
    rows = _rows(spark, location)
    grams = required_grams(term, mode) if term else set()
    if grams:
        hits = candidates(spark, location, grams)
        part_rows = _settings(spark, location).part_rows
        # As many numbers as the table has folders at most; they prune the scan.
        parts = [row.part for row in hits.select(F.floor(F.col("row_no") / part_rows).alias("part")).distinct().collect()]
        rows = rows.filter(F.col("part").isin(parts)).join(hits, "row_no", "left_semi")
    return search(rows, term, mode).drop("row_no", "part")
