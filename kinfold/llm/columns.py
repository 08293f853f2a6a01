"""Columns that only pass by."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plainly_named(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with columns c0, c1, ... but for those that are ``kept``. So no name clashes with those of an operator or
    needs quotes; ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)])
