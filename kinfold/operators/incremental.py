"""Exact copies kept from scan to scan.

A stored state has the files of the last scan with their group size and rank, and the size of every key's group, both
partitioned by a bucket of the key. The next scan is held against it by path and fingerprint: what is there once only is a
signed change (+1 new, -1 gone; a changed file is both). Changes sum up to signed counts by key, which are merged into the stored
groups. Only files of changed keys are ranked again, and only the buckets of these keys are read whole and written. Group
numbers, which any new group shifts, are given when the state is read.

A scan's cost: one narrow pass over both inventories, and work in proportion to the touched buckets.

An update writes what will replace the buckets first, then moves it to its place bucket by bucket. An update that died
in between is carried on by the next one (or ``recover``). One writer at a time, and readers wait for it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import schemas
from kinfold.operators.clean import derive_ages
from kinfold.operators.exact import KEYS, number_copies, with_status
from kinfold.operators.numbering import number_rows
from kinfold.sources.scratch import drop, materialize
from kinfold.sources.stages import move_path, path_exists, remove_path

#: Buckets of a state; more buckets mean less to write for a change, and more files.
BUCKETS = 64
_PRINT = ["print_a", "print_b"]
_BUCKETS = "name string, bucket int, has_rows boolean"
_GROUPS = "content_md5 string, size_bytes long, n_copies long, bucket int"
#: Ages change with the clock; they are derived when the state is read.
_TOLD = [f for f in schemas.CLEANED if f.name not in ("age_days", "idle_days")]
_MARKED = [*[f.name for f in _TOLD], *_PRINT, "bucket"]
_FILES = ", ".join(
    [*(f"{f.name} {f.dataType.simpleString()}" for f in _TOLD), *(f"{c} long" for c in (*_PRINT, "n_copies", "copy_rank")), "bucket int"]
)


def _marked(cleaned: DataFrame, buckets: int) -> DataFrame:
    """Each file with a 128-bit print of all that is told of it, and the bucket of its key."""
    told = [F.col(f.name) for f in _TOLD]
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")
    return cleaned.select(
        *told, F.xxhash64(*told).alias("print_a"), F.xxhash64(F.lit(1), *reversed(told)).alias("print_b"), bucket.alias("bucket")
    )


def _table(spark: SparkSession, location: str, name: str) -> DataFrame:
    schema = {"files": _FILES, "groups": _GROUPS}[name]
    if not path_exists(spark, f"{location}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{location}/{name}")


def _in(buckets: list[int]) -> Column:
    return F.col("bucket").isin(buckets)


def _write(rows: DataFrame, path: str) -> None:
    """A large bucket is written by several tasks, small ones share a task."""
    spread = rows.repartitionByRange("bucket", *KEYS, *(["path"] if "path" in rows.columns else []))
    spread.write.partitionBy("bucket").parquet(path)


def _replace(spark: SparkSession, location: str) -> None:
    """Moves the pending buckets to their places; a bucket that has no rows any more goes. One that was moved stays."""
    pending = f"{location}/pending"
    for name, bucket, has_rows in spark.read.schema(_BUCKETS).parquet(f"{pending}/buckets").collect():
        folder = f"{name}/bucket={bucket}"
        if not has_rows:
            remove_path(spark, f"{location}/{folder}")
        elif path_exists(spark, f"{pending}/{folder}"):
            remove_path(spark, f"{location}/{folder}")
            move_path(spark, f"{pending}/{folder}", f"{location}/{folder}")
    remove_path(spark, f"{pending}/buckets")
    remove_path(spark, pending)


def recover(spark: SparkSession, location: str) -> bool:
    """Ends an update that died while it replaced buckets; one that died before has changed nothing."""
    if not path_exists(spark, f"{location}/pending/buckets/_SUCCESS"):
        return False
    _replace(spark, location)
    return True


def _ranked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Files with group size and rank; ``groups`` has the sizes of their keys. Single files are not ranked."""
    shared = groups.na.drop(subset=KEYS).filter("n_copies > 1").select(*KEYS, "n_copies")
    numbered = number_rows(shared, KEYS, "exact_group_id", running_sum=("n_copies", "_start"))
    joined = materialize(rows.join(numbered, KEYS, "left"), "touched-files")
    copies = number_copies(joined.filter("exact_group_id IS NOT NULL"))
    single = joined.filter("exact_group_id IS NULL").withColumns({"n_copies": F.lit(1), "copy_rank": F.lit(1)})
    order = [*_MARKED[:-1], "n_copies", "copy_rank", "bucket"]
    kinds = {"n_copies": "long", "copy_rank": "long"}
    parts = [part.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in order]) for part in (single, copies)]
    return parts[0].unionByName(parts[1])


def start(cleaned: DataFrame, location: str, buckets: int = BUCKETS) -> None:
    """A state of no files, brought up to date with the first scan."""
    spark = cleaned.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("errorifexists").parquet(f"{location}/settings")
    update(cleaned, location)


def changes(cleaned: DataFrame, location: str) -> DataFrame:
    """(path, prints, key, bucket, sign): what a scan has that the state has not (+1) and the other way round (-1)."""
    spark = cleaned.sparkSession
    buckets = spark.read.parquet(f"{location}/settings").first().buckets
    row = ["path", *_PRINT, *KEYS, "bucket"]
    new = _marked(cleaned, buckets).select(*row, F.lit(1).alias("sign"))
    old = _table(spark, location, "files").select(*row, F.lit(-1).alias("sign"))
    return new.unionByName(old).groupBy(*row).agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def merged_groups(spark: SparkSession, location: str, delta: DataFrame, buckets: list[int]) -> DataFrame:
    """Stored sizes of some buckets' groups plus signed counts; groups of no file are gone."""
    stored = _table(spark, location, "groups").filter(_in(buckets))
    signed = delta.groupBy(*KEYS, "bucket").agg(F.sum("sign").alias("n_copies"))
    both = stored.unionByName(signed).groupBy(*KEYS, "bucket").agg(F.sum("n_copies").alias("n_copies"))
    return both.filter("n_copies > 0").select(*KEYS, "n_copies", "bucket")


def update(cleaned: DataFrame, location: str) -> list[int]:
    """Brings the state up to date with a new scan; returns the buckets that it wrote."""
    spark = cleaned.sparkSession
    recover(spark, location)
    remove_path(spark, f"{location}/pending")
    signed = materialize(changes(cleaned, location), "signed-changes")
    touched = [row.bucket for row in signed.select("bucket").distinct().collect()]
    if touched:
        buckets = spark.read.parquet(f"{location}/settings").first().buckets
        groups = materialize(merged_groups(spark, location, signed, touched), "merged-groups")
        row = ["path", *_PRINT]
        gone, come = (signed.filter(F.col("sign") == sign).select(*row) for sign in (-1, 1))
        stored = _table(spark, location, "files").filter(_in(touched)).join(gone, row, "left_anti")
        added = _marked(cleaned, buckets).filter(_in(touched)).join(come, row, "left_semi")
        # A null in a key equals nothing, so such files are no group and stay single.
        keys = signed.select(*KEYS).distinct()
        mine = stored.join(keys, KEYS, "left_semi").select(*_MARKED).unionByName(added.select(*_MARKED))
        untouched = stored.join(keys, KEYS, "left_anti")
        ranked = _ranked(mine, groups.join(keys, KEYS, "left_semi"))
        _write(groups, f"{location}/pending/groups")
        _write(untouched.unionByName(ranked), f"{location}/pending/files")
        pending = f"{location}/pending"
        marks = [(name, b, path_exists(spark, f"{pending}/{name}/bucket={b}")) for name in ("groups", "files") for b in touched]
        spark.createDataFrame(marks, _BUCKETS).coalesce(1).write.parquet(f"{pending}/buckets")
        _replace(spark, location)
        drop(groups)
    drop(signed)
    return sorted(touched)


def exact_rows(spark: SparkSession, location: str, as_of: str | datetime) -> DataFrame:
    """The exact stage of the state, with ages at ``as_of``."""
    recover(spark, location)
    files = derive_ages(_table(spark, location, "files"), as_of)
    shared = _table(spark, location, "groups").na.drop(subset=KEYS).filter("n_copies > 1").select(*KEYS)
    ids = materialize(number_rows(shared, KEYS, "exact_group_id"), "group-ids")
    copies = files.filter("n_copies > 1").join(ids, KEYS)
    single = files.filter("n_copies = 1").withColumn("exact_group_id", F.lit(-1))
    both = [part.withColumn("is_exact_dup", F.lit(flag)) for part, flag in ((single, False), (copies, True))]
    rows = [with_status(part).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.EXACT]) for part in both]
    return rows[0].unionByName(rows[1])
