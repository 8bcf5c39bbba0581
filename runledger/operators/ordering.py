"""Positions and running totals along an order, for groups of any size.

A window over a group puts that group in one task. These operators sort the whole table by range, so
that a hot group is cut into many slices, add up each slice, and shift every slice by the total of the
slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.session import stored
from runledger.sizing import keyed_join, quoted


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    weight: Column | None = None,
    name: str = "row_no",
) -> DataFrame:
    """Add the inclusive running total of ``weight`` (default 1: the row number from 1).

    ``order`` should be total within a group: end it with a unique column.
    """
    counting = weight is None
    weight = F.lit(1).cast("bigint") if counting else weight
    columns = [F.col(quoted(k)) for k in keys]
    # The stored table fixes slice numbers and places: they come out the same if a task is run again,
    # although range bounds are sampled.
    placed = stored(
        df.repartitionByRange(*columns, *order)
        .sortWithinPartitions(*columns, *order)
        .select(
            "*",
            weight.alias("__slice_weight"),
            F.spark_partition_id().alias("__slice"),
            F.monotonically_increasing_id().alias("__slice_place"),
        ),
        "slices",
    )
    slices = placed.groupBy(*columns, "__slice").agg(
        F.sum("__slice_weight").alias("__slice_total"), F.min("__slice_place").alias("__slice_first")
    )
    before = Window.partitionBy(*columns).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = slices.select(
        *columns, "__slice", "__slice_first", F.coalesce(F.sum("__slice_total").over(before), F.lit(0)).alias("__slice_shift")
    )
    joined = keyed_join(placed, shifts, [*keys, "__slice"])
    if counting:
        # Places within a slice have no gaps, so plain numbering needs no second shuffle.
        local = F.col("__slice_place") - F.col("__slice_first") + 1
    else:
        within = (
            Window.partitionBy(*columns, "__slice")
            .orderBy("__slice_place")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        local = F.sum("__slice_weight").over(within)
    joined = joined.withColumn("__slice_local", local)
    return joined.select(
        *[F.col(quoted(c)) for c in df.columns], (F.col("__slice_local") + F.col("__slice_shift")).alias(name)
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[Column], column: str, name: str
) -> DataFrame:
    """Add the value ``column`` has on the row before, within the group; null on the first row."""
    numbered = running_total(df, keys, order, name="__row")
    earlier = numbered.select(
        *[F.col(quoted(k)) for k in keys],
        (F.col("__row") + 1).alias("__row"),
        F.col(quoted(column)).alias(name),
    )
    return keyed_join(numbered, earlier, [*keys, "__row"], "left").drop("__row")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts every group to ``n`` rows before the shuffle."""
    along = Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(along)).where(F.col("__row") <= n).drop("__row")
