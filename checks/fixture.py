"""The test inventory: one file per document, with dirty cases added on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import schemas

AS_OF = "2025-01-01 00:00:00"

# Suffix by doc_id % 12, sub-folder by doc_id % 3.
_SUFFIXES = [".PDF", ".pdf", ".docx", ".TXT", ".txt", ".md", ".csv", ".tar.gz", "", ".pdf", ".docx", ".txt"]
_FOLDERS = ["", "a/", "a/b/"]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a file path, its size and dates; the content stays in ``text``."""
    doc = F.col("doc_id")
    number = doc.cast("string")
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")

    def pick(values: list[str]):
        return F.get(F.array(*map(F.lit, values)), (doc % len(values)).cast("int"))

    def moment(hours):
        return F.date_format(start + F.make_dt_interval(hours=hours.cast("int")), "yyyy-MM-dd HH:mm:ss")

    base = F.when(doc % 97 == 5, "___").otherwise(F.concat(F.lit("Rapport-"), number, F.lit(" v1")))
    named = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .withColumn("name", F.concat(base, pick(_SUFFIXES)))
        .withColumn("folder", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")))
    )
    path = (
        F.when(doc % 50 == 1, F.concat(F.lit("/"), "name"))
        .when(doc % 41 == 2, F.concat("folder", F.lit("node_modules/"), "name"))
        .otherwise(F.concat("folder", F.lit("u"), (doc % 7).cast("string"), F.lit("/"), pick(_FOLDERS), "name"))
    )
    created = (doc * 37) % 8760
    modified = created + F.when(doc % 47 == 11, -24).otherwise((doc % 90) * 24)
    return named.withColumns(
        {
            "path": path,
            "size_bytes": F.octet_length("text").cast("long") * 8192,
            "created_at_raw": F.when(doc % 53 == 9, "2023-02-30 00:00:00").otherwise(moment(created)),
            "modified_at_raw": moment(modified),
        }
    )


def inventory_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = document_files(spark, sf_dir).select(
        "doc_id",
        F.lit(0).alias("copy"),
        F.col("name").alias("file_name"),
        F.when(doc % 10 == 3, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path")).alias("path"),
        "size_bytes",
        F.when(doc % 12 == 7, ".gz")
        .otherwise(F.get(F.array(*map(F.lit, _SUFFIXES)), (doc % 12).cast("int")))
        .alias("extension"),
        F.when(doc % 61 != 7, F.md5("text")).alias("content_md5"),
        "created_at_raw",
        "modified_at_raw",
    )
    repeated = F.explode(F.when(doc % 29 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (
        rows.withColumn("copy", repeated)
        .withColumn("seq", doc * 2 + F.col("copy"))
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RAW])
    )


def inventory_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier scan of the same storage: some files were not there yet, had other content or another place, and some
    copies have gone since. Every file of ``inventory_raw`` is new, changed, moved or the same."""
    rows, number = inventory_raw(spark, sf_dir), F.floor(F.col("seq") / 2)
    older = F.col("content_md5").isNotNull() & (number % 31 == 8)
    was = rows.filter(number % 23 != 6).withColumns(
        {
            "content_md5": F.when(older, F.md5(F.concat("content_md5", F.lit("older")))).otherwise(F.col("content_md5")),
            "size_bytes": F.when(older, F.col("size_bytes") + 8192).otherwise(F.col("size_bytes")),
            "path": F.when(number % 37 == 9, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")),
        }
    )
    gone = rows.filter(number % 29 == 3).withColumns(
        {"path": F.concat("path", F.lit(".gone.txt")), "seq": -F.col("seq") - 1}
    )
    return was.unionByName(gone).select(*rows.columns)
