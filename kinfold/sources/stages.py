"""Stage tables on disk: one Parquet folder per stage below ``<root>/<run_id>``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinfold import schemas

# Written last, so its success marker says that a run is complete.
LAST_STAGE = "kpis"


def stage_path(root: str, run_id: str, stage: str) -> str:
    return f"{root.rstrip('/')}/{run_id}/{stage}"


def _filed(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, location: str) -> bool:
    system, path = _filed(spark, location)
    return system.exists(path)


def remove_path(spark: SparkSession, location: str) -> None:
    system, path = _filed(spark, location)
    system.delete(path, True)


def move_path(spark: SparkSession, location: str, target: str) -> None:
    system, path = _filed(spark, location)
    place = _filed(spark, target)[1]
    system.mkdirs(place.getParent())
    if not system.rename(path, place):
        raise OSError(f"{location} could not be moved to {target}")


def _marker(spark: SparkSession, root: str, run_id: str):
    return _filed(spark, stage_path(root, run_id, LAST_STAGE) + "/_SUCCESS")


def has_results(spark: SparkSession, root: str, run_id: str) -> bool:
    system, path = _marker(spark, root, run_id)
    return system.exists(path)


def reopen_run(spark: SparkSession, root: str, run_id: str) -> None:
    """A run that is written again counts as incomplete until its last stage is there."""
    system, path = _marker(spark, root, run_id)
    system.delete(path, False)


def write_stage(df: DataFrame, root: str, run_id: str, stage: str) -> DataFrame:
    path = stage_path(root, run_id, stage)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schemas.STAGES[stage]).parquet(path)


def read_stage(spark: SparkSession, root: str, run_id: str, stage: str) -> DataFrame:
    """A stage that was never written reads as an empty table with the stage's columns."""
    schema = schemas.STAGES[stage]
    try:
        return spark.read.schema(schema).parquet(stage_path(root, run_id, stage))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    return {stage: read_stage(spark, root, run_id, stage) for stage in schemas.STAGES}


def write_run_rows(df: DataFrame, root: str, run_id: str, stage: str) -> DataFrame:
    """A stage of one run in the table of that stage across runs; other runs' rows stay as they are."""
    path = f"{root.rstrip('/')}/all-runs/{stage}"
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return read_runs(df.sparkSession, root, stage, [run_id])


def read_runs(spark: SparkSession, root: str, stage: str, run_ids: list[str] | None = None) -> DataFrame:
    """Rows of a stage with their ``run_id``, of all runs or some; only these runs' folders are read."""
    schema = StructType([*schemas.STAGES[stage], StructField("run_id", StringType())])
    path = f"{root.rstrip('/')}/all-runs/{stage}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if run_ids is None else rows.filter(F.col("run_id").isin(run_ids))
