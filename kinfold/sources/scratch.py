"""Intermediate tables on the cluster's shared storage.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs a
re-read and not the whole history. The table's size is known to the optimiser, which then picks the joins. Shuffle files
of the job that wrote a table go with the job, as nothing reads them again.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = tempfile.mkdtemp(prefix="kinfold-")
    return _own_roots[context.applicationId]


def _remove(spark: SparkSession, location: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that still read them must be written before."""
    _remove(spark, f"{scratch_root(spark).rstrip('/')}/kinfold/{spark.sparkContext.applicationId}")


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` whose last reader is written."""
    for table in tables:
        _remove(table.sparkSession, _places.pop(table))


def new_location(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/kinfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    location = new_location(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(location)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(location)
    _places[table] = location
    return table
