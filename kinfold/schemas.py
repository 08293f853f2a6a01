"""One declared schema per stage table; empty results carry the same columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


RAW = _table(
    ("seq", _L),
    ("file_name", _S),
    ("path", _S),
    ("size_bytes", _L),
    ("extension", _S),
    ("content_md5", _S),
    ("created_at_raw", _S),
    ("modified_at_raw", _S),
)

CLEANED = _table(
    ("name_key", _S),
    ("path", _S),
    ("parent_dir", _S),
    ("dir_depth", _L),
    ("size_bytes", _L),
    ("size_label", _S),
    ("size_class", _S),
    ("extension", _S),
    ("content_md5", _S),
    ("created_at", _TS),
    ("modified_at", _TS),
    ("age_days", _L),
    ("idle_days", _L),
)

EXACT = T.StructType(
    CLEANED.fields
    + _table(
        ("n_copies", _L), ("is_exact_dup", _B), ("copy_rank", _L), ("exact_group_id", _L), ("dup_status", _S)
    ).fields
)

NEAR = T.StructType(
    EXACT.fields
    + _table(("cluster_id", _L), ("cluster_status", _S), ("cluster_size", _L), ("similarity", _D)).fields
)

COMBINED = _table(
    ("name_key", _S),
    ("path", _S),
    ("parent_dir", _S),
    ("size_bytes", _L),
    ("extension", _S),
    ("dup_type", _S),
    ("group_key", _S),
    ("depot", _S),
    ("unit", _S),
    ("owner", _S),
)

HOTSPOTS = _table(
    ("rank", _L), ("depot", _S), ("unit", _S), ("n_files", _L), ("total_bytes", _L), ("total_label", _S)
)

KPIS = _table(("metric", _S), ("value", _D))

STAGES = {
    "raw": RAW,
    "cleaned": CLEANED,
    "exact": EXACT,
    "near": NEAR,
    "combined": COMBINED,
    "hotspots": HOTSPOTS,
    "kpis": KPIS,
}
