"""One large, skewed run for plan and skew checks.  usage: python scale_probe.py COPIES [no-broadcast]

The fixture of sf0.1 is replicated COPIES times with shifted ids; a third of all files get one content, size and
date, and a third of the rest one extension with a tight spread of metadata. Stage times go to stdout.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.operators.clean import clean_inventory
from kinfold.operators.combine import combined_duplicates
from kinfold.operators.exact import exact_duplicates
from kinfold.operators.near import near_duplicates
from kinfold.operators.rollups import breakdown_all, hotspots, kpis
from checks.fixture import AS_OF, inventory_raw
from kinfold.sources.scratch import materialize

SF_DIR = "/root/testdata/sf0.1"


def inflated(spark: SparkSession, copies: int):
    base = materialize(inventory_raw(spark, SF_DIR), "probe-base")
    i = F.col("i").cast("string")
    pick = F.pmod(F.xxhash64("seq", "i"), F.lit(9))
    rows = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = pick < 3
    return rows.select(
        (F.col("seq") * copies + F.col("i")).alias("seq"),
        "file_name",
        F.concat(F.lit("/r"), i, F.col("path")).alias("path"),
        F.when(hot, 8192).otherwise(F.col("size_bytes") + F.when(pick < 5, 0).otherwise(F.col("i"))).alias("size_bytes"),
        F.when(pick < 5, ".log").otherwise(F.col("extension")).alias("extension"),
        F.when(hot, "d41d8cd98f00b204e9800998ecf8427e")
        .when(pick < 8, F.md5(F.concat("content_md5", i)))
        .otherwise(F.col("content_md5"))
        .alias("content_md5"),
        F.when(hot, "1980-01-01 00:00:00").otherwise(F.col("created_at_raw")).alias("created_at_raw"),
        "modified_at_raw",
    )


def main() -> None:
    copies = int(sys.argv[1])
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if "no-broadcast" in sys.argv:
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name, df):
        began = time.perf_counter()
        out = materialize(df() if callable(df) else df, name)
        print(f"{name:12} {time.perf_counter() - began:7.1f} s  {out.count():>12,} rows", flush=True)
        return out

    raw = timed("raw", inflated(spark, copies))
    cleaned = timed("cleaned", clean_inventory(raw, AS_OF))
    exact = timed("exact", lambda: exact_duplicates(cleaned))
    near = timed("near", lambda: near_duplicates(exact))
    combined = timed("combined", combined_duplicates(exact, near))
    for name, query in (("hotspots", hotspots), ("kpis", kpis), ("breakdowns", breakdown_all)):
        timed(name, query(combined))
    largest = exact.agg(F.max("n_copies"), F.max("copy_rank"), F.max("exact_group_id")).first()
    print("largest group, rank, group id:", tuple(largest))
    print("clusters:", near.agg(F.max("cluster_id"), F.max("cluster_size")).first())
    spark.stop()


if __name__ == "__main__":
    main()
