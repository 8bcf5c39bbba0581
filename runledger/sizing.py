"""Column references by name, joins on keys that may be null, and partitions for costly scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spread(df: DataFrame) -> DataFrame:
    """Spread costly per-row work over the cores where a scan has fewer partitions than there are cores.

    For scans only: asking a plan with a shuffle for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def quoted(name: str) -> str:
    """Column reference for a name that may contain dots or dashes."""
    return name if name.startswith("`") else f"`{name}`"


def keyed_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None
) -> DataFrame:
    """Join on equal keys, nulls included, and any extra condition; keeps the left keys only.

    Other columns must differ in name between the sides. The right side gets fresh columns, so both
    sides may stem from one DataFrame.
    """
    fresh = {k: f"__right_{i}" for i, k in enumerate(keys)}
    side = right.select(
        *[F.col(quoted(k)).alias(f) for k, f in fresh.items()],
        *[F.col(quoted(c)).alias(c) for c in right.columns if c not in fresh],
    )
    condition = F.lit(True) if extra is None else extra
    for k, f in fresh.items():
        condition = F.col(quoted(k)).eqNullSafe(F.col(f)) & condition
    return left.join(side, condition, how).drop(*fresh.values())
