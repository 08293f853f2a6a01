"""Running numbers over a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize

# monotonically_increasing_id() keeps the row's place in its partition in the low 33 bits.
_PLACE_BITS = 33
_PLACE_MASK = (1 << _PLACE_BITS) - 1


def number_rows(df: DataFrame, order: list[str], number: str, running_sum: tuple[str, str] | None = None) -> DataFrame:
    """Add ``number``: the 0-based place of each row in ``order``, which must be unique.

    The rows are range-partitioned, so ties on a leading column still spread over tasks. The ranged rows are
    written once: range bounds are sampled, and a second evaluation could cut elsewhere. ``running_sum``
    ``(column, name)`` also adds the sum of ``column`` over all earlier rows.
    """
    ranged = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()),
        number,
    )
    part, place = F.shiftright("_seq", _PLACE_BITS), F.col("_seq").bitwiseAND(_PLACE_MASK)
    ranged = ranged.withColumns({"_part": part, "_place": place})
    weight = running_sum[0] if running_sum else None
    # One row per range partition: the window over it and the broadcast are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(
        F.count("*").alias("_rows"), (F.sum(weight) if weight else F.lit(0)).alias("_sum")
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
    )
    placed = ranged.join(F.broadcast(offsets), "_part")
    added: dict[str, Column] = {number: (F.col("_place") + F.col("_rows_before")).cast("long")}
    if running_sum:
        within = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.coalesce(F.sum(weight).over(within), F.lit(0))
        added[running_sum[1]] = (earlier + F.col("_sum_before")).cast("long")
    return placed.withColumns(added).select(*df.columns, *added)
