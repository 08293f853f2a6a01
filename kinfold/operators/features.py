"""Standardised metadata features of near-copy candidates.

A candidate is four numbers (size, depth, age, idle days) and two one-hot encoded categories (extension, size
class). The one-hot columns are never built. Standardised, a category of frequency p takes one of two values, so
distances and dot products between rows follow from the frequencies alone:

* two rows that differ in a category are 1/(p(1-p)) + 1/(q(1-q)) apart (squared) in its columns, at least 8;
* with r = p/(1-p) and R the sum of all r, the columns of one row have the squared norm (1-p)/p + R - r, and two
  rows with different categories p, q have the dot product R - r_p - r_q - 2.

A category that all rows share has a constant column, which standardises to 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize

NUMBERS = ["size_bytes", "dir_depth", "age_days", "idle_days"]
CATEGORIES = ["extension", "size_class"]
AXES = range(1, len(NUMBERS) + 1)
Z = [f"z{k}" for k in AXES]

# Below this relative spread a column counts as constant (the double rounding unit).
_ROUNDING = 2.220446049250313e-16


@dataclass(frozen=True)
class Scaling:
    """One-row statistics of the candidates: row count, and mean and divisor per number."""

    rows: int
    means: list[float]
    divisors: list[float]

    def scores(self, rows: DataFrame) -> list[Column]:
        return [
            ((value - mean) / divisor).alias(z)
            for value, mean, divisor, z in zip(numbers(rows), self.means, self.divisors, Z, strict=True)
        ]


def candidates(exact: DataFrame) -> DataFrame:
    """One file per content: unique files and the originals of copies."""
    return exact.filter(~F.col("is_exact_dup") | (F.col("copy_rank") == 1))


def numbers(rows: DataFrame) -> list[Column]:
    return [F.coalesce(rows[name], F.lit(0)).cast("double") for name in NUMBERS]


def block_stats(rows: DataFrame) -> DataFrame:
    """Row count, means and variances per (extension, size class): the only pass over the rows for statistics."""
    values = numbers(rows)
    return rows.groupBy(*CATEGORIES).agg(
        F.count("*").alias("n"),
        *[F.avg(v).alias(f"mean{k}") for k, v in zip(AXES, values, strict=True)],
        *[F.var_pop(v).alias(f"var{k}") for k, v in zip(AXES, values, strict=True)],
    )


def scaling(blocks: DataFrame) -> Scaling:
    """Means and population deviations of the whole from those of the blocks."""
    first = blocks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        *[(F.sum(F.col("n") * F.col(f"mean{k}")) / F.sum("n")).alias(f"mean{k}") for k in AXES],
    ).first()
    rows = first["rows"]
    if not rows:
        return Scaling(0, [0.0] * len(NUMBERS), [1.0] * len(NUMBERS))
    means = [first[f"mean{k}"] for k in AXES]
    second = blocks.agg(
        *[
            (F.sum(F.col("n") * (F.col(f"var{k}") + F.pow(F.col(f"mean{k}") - m, 2))) / rows).alias(f"var{k}")
            for k, m in zip(AXES, means, strict=True)
        ]
    ).first()
    divisors = []
    for k, mean in zip(AXES, means, strict=True):
        variance = second[f"var{k}"]
        constant = variance <= rows * _ROUNDING * variance + (rows * mean * _ROUNDING) ** 2
        divisors.append(1.0 if constant else variance**0.5)
    return Scaling(rows, means, divisors)


def category_shares(blocks: DataFrame, category: str, rows: int) -> DataFrame:
    """Per value: its share p of the rows, r = p/(1-p) and the distance penalty 1/(p(1-p)); 0 for a constant."""
    p = F.col("p")
    return (
        blocks.groupBy(category)
        .agg((F.sum("n") / rows).alias("p"))
        .withColumn("r", F.when(p < 1, p / (1 - p)).otherwise(0.0))
        .withColumn("penalty", F.when(p < 1, 1 / (p * (1 - p))).otherwise(0.0))
    )


def category_stats(blocks: DataFrame, rows: int) -> DataFrame:
    """Both categories as one table of (feature, value, n, p, penalty, own squared norm)."""
    tables = []
    for category in CATEGORIES:
        shares = category_shares(blocks, category, rows)
        total = shares.agg(F.sum("r").alias("t")).scalar()
        tables.append(
            shares.select(
                F.lit(category).alias("feature"),
                F.col(category).alias("value"),
                F.round(F.col("p") * rows).cast("long").alias("n"),
                "p",
                "penalty",
                own_norm(F.col("p"), F.col("r"), total).alias("norm"),
            )
        )
    return tables[0].unionByName(tables[1])


def own_norm(p: Column, r: Column, total: Column) -> Column:
    """Squared norm of a category's standardised one-hot columns."""
    return F.when(p < 1, (1 - p) / p + total - r).otherwise(0.0)


def category_blocks(blocks: DataFrame, rows: int) -> DataFrame:
    """The blocks with a number, the shares of both categories and the one-hot norm of their rows."""
    out = blocks.select(*CATEGORIES, "n")
    for name, category in zip(("ext", "class"), CATEGORIES, strict=True):
        shares = category_shares(blocks, category, rows)
        total = shares.agg(F.sum("r").alias("t")).scalar()
        out = out.join(
            shares.select(
                category,
                F.col("r").alias(f"{name}_r"),
                F.col("penalty").alias(f"{name}_penalty"),
                own_norm(F.col("p"), F.col("r"), total).alias(f"{name}_norm"),
                (total + F.lit(0.0)).alias(f"{name}_total"),
            ),
            category,
        )
    return materialize(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def standardized(rows: DataFrame, scale: Scaling) -> DataFrame:
    return rows.select("*", *scale.scores(rows))
