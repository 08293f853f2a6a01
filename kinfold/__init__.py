"""Duplicate-file analytics on Spark: every stage is a DataFrame -> DataFrame function."""
