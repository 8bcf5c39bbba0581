"""Anchored one-dimensional clusters: a cluster ends where a time is more than the spacing past its start.

This is not a session gap: the distance counts from the first time of the cluster. So where a stretch of time is
entered decides all that follows in it. Each stretch is therefore turned into a function, from the start it is
entered with to the last start in it and the number of starts; these functions are composed along the stretches,
and then every stretch knows its own entry. No stretch waits for the clusters of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runledger.sizing import keyed_join, quoted

# Seconds of a stretch: it holds no more distinct times, unless the spacing is wider.
STRETCH = 1 << 22


def anchored_clusters(
    df: DataFrame, keys: list[str], seconds: str, spacing: str, name: str = "cluster", stretch: int = STRETCH
) -> DataFrame:
    """Add the cluster number (from 0) of each row's time within its group.

    ``seconds`` is an integer time, ``spacing`` a positive integer column that is constant in a group. Only the
    distinct times of a group are looked at, so repeated runs at a time cost nothing. A task holds one stretch of
    ``stretch`` seconds, or of one spacing if that is longer. Of each stretch, only the functions' steps within the
    first spacing meet in one task per group, which reads them one by one.
    """
    columns = [F.col(quoted(k)) for k in keys]
    t, gap = F.col(quoted(seconds)).cast("bigint"), F.col(quoted(spacing)).cast("bigint")
    wide = F.greatest(F.lit(1), F.floor(F.lit(stretch) / gap)) * gap
    points = (
        df.select(F.lit(0).alias("__all"), *columns, t.alias("__t"), gap.alias("__gap"), F.floor(t / wide).alias("__cell"), wide.alias("__wide"))
        .where("__t is not null")
        .distinct()
    )
    whole = ["__all", *keys]
    own = [f for f in points.schema.fields if f.name in whole]
    groups, cells = [F.col(quoted(k)) for k in whole], [F.col(quoted(k)) for k in [*whole, "__cell"]]
    number = StructField("__cell", LongType())

    steps = points.groupBy(*cells).applyInArrow(
        _steps(whole), StructType([*own, number, *(StructField(n, LongType()) for n in ("__hit", "__gap", "__exit", "__starts"))])
    )
    ordered = steps.repartition(*groups).sortWithinPartitions(*cells, "__hit")
    entries = ordered.mapInArrow(
        _entries(len(whole)), StructType([*own, number, StructField("__entry", LongType()), StructField("__before", LongType())])
    )
    entered = keyed_join(points, entries, [*whole, "__cell"])
    numbered = entered.groupBy(*cells).applyInArrow(_numbers(whole), StructType([*own, StructField("__t", LongType()), StructField("__cluster", LongType())]))
    renamed = numbered.drop("__all").withColumnRenamed("__cluster", name).withColumnRenamed("__t", seconds)
    return keyed_join(df, renamed, [*keys, seconds], "left")


def _sorted(table: pa.Table) -> tuple[np.ndarray, int]:
    return np.sort(table.column("__t").to_numpy()), table.column("__gap")[0].as_py()


def _repeated(table: pa.Table, names: list[str], count: int) -> dict[str, pa.ChunkedArray]:
    return {n: table.column(n).take(pa.array(np.zeros(count, np.int64))) for n in names}


def _steps(keys: list[str]):
    """A stretch as a function: for its first time hit, ``__hit``, the last start and the number of starts.

    An entry from before the stretch hits no time later than the first one that is a spacing past its beginning.
    Times that lead to the same exit in as many starts are one step, named by its latest time.
    """

    def run(table: pa.Table) -> pa.Table:
        t, gap = _sorted(table)
        n = len(t)
        begin = table.column("__cell")[0].as_py() * table.column("__wide")[0].as_py()
        jump = np.append(np.searchsorted(t, t + gap, "right"), n)
        last, starts = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
        # Doubling: after k rounds ``last`` is the start reached in 2 ** k - 1 jumps, or the last one in the stretch.
        while (jump < n).any():
            further = jump < n
            starts = np.where(further, starts + starts[jump], starts)
            last = np.where(further, last[jump], last)
            jump = np.where(further, jump[jump], n)
        count = min(n, int(np.searchsorted(t, begin + gap, "left")) + 1)
        exits, starts = t[last[:count]], starts[:count]
        ends = np.flatnonzero(np.append((exits[1:] != exits[:-1]) | (starts[1:] != starts[:-1]), True))
        columns = {"__hit": t[ends], "__gap": np.full(len(ends), gap), "__exit": exits[ends], "__starts": starts[ends]}
        return pa.table({**_repeated(table, [*keys, "__cell"], len(ends)), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}})

    return run


def _entries(width: int):
    """Compose the functions of a group's stretches in order: the start and the number of starts before each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = cell = entry = None
        number, done = 0, True
        for batch in batches:
            rows, kept, entries, before = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], [], []
            for at, row in enumerate(rows):
                if row[:width] != group and str(row[:width]) != str(group):
                    group, cell, entry, number = row[:width], None, None, 0
                hit, gap, last, starts = row[width + 1 :]
                if row[width] != cell:
                    cell, done = row[width], False
                    kept.append(at)
                    entries.append(entry)
                    before.append(number)
                # The first step whose latest time is past the entry's reach holds the time that is hit.
                if not done and (entry is None or hit > entry + gap):
                    entry, number, done = last, number + starts, True
            if kept:
                arrays = [batch.column(i).take(pa.array(kept)) for i in range(width + 1)]
                arrays += [pa.array(entries, pa.int64()), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: width + 1], "__entry", "__before"])

    return run


def _numbers(keys: list[str]):
    """Cluster numbers of a stretch's times, from its entry."""

    def run(table: pa.Table) -> pa.Table:
        t, gap = _sorted(table)
        entry, before = table.column("__entry")[0].as_py(), table.column("__before")[0].as_py()
        starts, at = [], 0 if entry is None else int(np.searchsorted(t, entry + gap, "right"))
        while at < len(t):
            starts.append(at)
            at = int(np.searchsorted(t, t[at] + gap, "right"))
        number = before - 1 + np.searchsorted(np.array(starts, np.int64), np.arange(len(t)), "right")
        return pa.table({**_repeated(table, keys, len(t)), "__t": pa.array(t), "__cluster": pa.array(number.astype(np.int64))})

    return run


def cluster_labels(df: DataFrame, keys: list[str], time: str, cluster: str = "cluster") -> DataFrame:
    """One row per cluster: ``YYYY-MM-DD (HH:MM - HH:MM)`` from its first and last time."""
    return df.groupBy(*[F.col(quoted(k)) for k in keys], cluster).agg(
        F.format_string(
            "%s (%s - %s)",
            F.date_format(F.min(time), "yyyy-MM-dd"),
            F.date_format(F.min(time), "HH:mm"),
            F.date_format(F.max(time), "HH:mm"),
        ).alias("label"),
        F.count(F.lit(1)).alias("items"),
    )
