"""The five stages end to end. Every stage is written and the next one reads it back.

What a stage reports when it is done is observed while it is written, so counting takes no further scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinfold import labels
from kinfold.operators import combine, rollups
from kinfold.operators.clean import clean_inventory
from kinfold.operators.exact import exact_duplicates
from kinfold.operators.near import near_duplicates
from kinfold.sources import stages


COUNTERS = "counters"


def _counted(stage: str) -> dict[str, Column]:
    """Counters by stage. Clusters are numbered from 0 on, so the largest number tells how many there are."""
    rows = F.count(F.lit(1))
    return {
        "raw": {"indexed_files": rows},
        "cleaned": {"valid_files": rows},
        "exact": {"exact_duplicate_files": F.count_if("is_exact_dup")},
        "near": {
            "clustered_files": F.count_if(F.col("cluster_id") != -1),
            "clusters": F.coalesce(F.max("cluster_id"), F.lit(-1)) + 1,
        },
        "combined": {"combined_files": rows},
    }.get(stage, {})


def read_counters(spark, root: str, run_id: str) -> DataFrame:
    """(counter, n) of a finished run."""
    return spark.read.schema("counter string, n long").parquet(stages.stage_path(root, run_id, COUNTERS))


def run_pipeline(
    raw: DataFrame,
    as_of: str | datetime,
    root: str,
    run_id: str,
    eps: float = labels.EPS,
    min_samples: int = labels.MIN_SAMPLES,
    positions: dict[str, int] = combine.DIMENSIONS,
) -> dict[str, DataFrame]:
    """Run all stages on a raw inventory into ``<root>/<run_id>``; the indicators are written last."""

    counters: list[tuple[str, int]] = []

    def keep(stage: str, df: DataFrame) -> DataFrame:
        wanted = _counted(stage)
        if not wanted:
            return stages.write_stage(df, root, run_id, stage)
        seen = Observation()
        written = stages.write_stage(df.observe(seen, *[c.alias(name) for name, c in wanted.items()]), root, run_id, stage)
        counters.extend((name, int(seen.get[name])) for name in wanted)
        return written

    spark = raw.sparkSession
    stages.reopen_run(spark, root, run_id)
    out = {"raw": keep("raw", raw)}
    out["cleaned"] = keep("cleaned", clean_inventory(out["raw"], as_of))
    out["exact"] = keep("exact", exact_duplicates(out["cleaned"]))
    out["near"] = keep("near", near_duplicates(out["exact"], eps, min_samples))
    out["combined"] = keep("combined", combine.combined_duplicates(out["exact"], out["near"], positions))
    out["hotspots"] = keep("hotspots", rollups.all_hotspots(out["combined"]))
    spark.createDataFrame(counters, "counter string, n long").write.mode("overwrite").parquet(
        stages.stage_path(root, run_id, COUNTERS)
    )
    out["kpis"] = keep("kpis", rollups.kpis(out["combined"]))
    return out
