"""Time series, scaling, frame break-down and commit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.dates import epoch_seconds
from runledger.functions.numbers import no_zero_cell, round_even
from runledger.functions.text import series_title
from runledger.operators.aggregates import commit_stats, no_null_keys, point_members, point_stats, small_values, squeeze
from runledger.operators.filters import between_epochs, equal_to, members
from runledger.operators.quantiles import aggregate_with_percentiles
from runledger.plans.options import SCALE_VIEW, TIME_SERIES, ChartOptions, EmptyResultError, FieldMapping
from runledger.sizing import quoted

SMALL_NAME = "below %s s"
SMALL_PATH = "parts with a mean below %s s, added up"


def selected_reports(reports: DataFrame, mapping: FieldMapping, options: ChartOptions) -> DataFrame:
    """Filtered reports with canonical fields; filters name canonical or source fields."""
    known = {n: mapping.column(n) for n in mapping.fields if mapping.has(n)}
    condition = equal_to(options.filters, known)
    if options.time_range:
        condition = condition & between_epochs(mapping.column("git.datetime"), *options.time_range)
    return mapping.apply(reports.where(condition), keep=("_id",))


def group_fields(mapping: FieldMapping, options: ChartOptions) -> dict[str, str]:
    """Fields that tell series apart, with their display names."""
    names = dict(mapping.group_names)
    if options.mode == SCALE_VIEW:
        names["git.commit"] = "commit"
        return {k: v for k, v in names.items() if k not in ("problem.cpu", "problem.size")}
    if options.mode != TIME_SERIES:
        raise ValueError(f"unknown view mode {options.mode!r}")
    for field, name in (("problem.cpu", "cpu"), ("problem.size", "size"), ("problem.test", "test"), ("problem.case", "case")):
        if mapping.has(field):
            names[field] = name
    return names


def charted(reports: DataFrame, mapping: FieldMapping, options: ChartOptions) -> tuple[DataFrame, list[str]]:
    """One row per report with its group fields, ``x``, ``y``, ``commit`` and ``_id``; and the point keys.

    Rows with a null key are left out. In the scale view x is the CPU count. When squeezing, x is the
    number of the group and ``x_label`` its text.
    """
    rows = selected_reports(reports, mapping, options)
    groups = list(group_fields(mapping, options))
    x = "problem.cpu" if options.mode == SCALE_VIEW else "git.datetime"
    rows = no_null_keys(rows, [*groups, x]).select(
        *[F.col(quoted(k)) for k in groups],
        F.col(quoted(x)).alias("x"),
        F.col("`result.duration`").cast("double").alias("y"),
        F.col("`git.commit`").alias("commit"),
        "_id",
    )
    if options.squeeze <= 1:
        return rows, [*groups, "x"]
    if options.mode == SCALE_VIEW:
        rows = rows.withColumn("x", F.col("x").cast("string"))
    squeezed = squeeze(rows, groups, "x", options.squeeze)
    squeezed = squeezed.withColumn("x", F.col("squeeze_no")).withColumnRenamed("squeeze_label", "x_label")
    return squeezed.drop("squeeze_no"), [*groups, "x", "x_label"]


def titled(points: DataFrame, mapping: FieldMapping, options: ChartOptions) -> DataFrame:
    """Replace the point keys by ``chart``, ``series``, ``x`` (text) and ``x_order``.

    Done on aggregated points, so the texts are not shuffled with the reports. The scale view's x is the
    CPU count as text; ``x_order`` keeps its numeric order.
    """
    groups = group_fields(mapping, options)
    charts = [k for k in groups if k in options.split_charts_by]
    series = [k for k in groups if k not in options.split_charts_by]

    def title(keys: list[str]) -> Column:
        return series_title([groups[k] for k in keys], [F.col(quoted(k)) for k in keys])

    x = F.col("x")
    if options.squeeze > 1:
        label, order = F.col("x_label"), x
    elif options.mode == SCALE_VIEW:
        label, order = x.cast("string"), x
    else:
        label, order = F.date_format(x, "yyyy-MM-dd HH:mm:ss"), epoch_seconds(x)
    rest = [c for c in points.columns if c not in (*groups, "x", "x_label")]
    return points.select(
        title(charts).alias("chart"),
        title(series).alias("series"),
        label.alias("x"),
        order.cast("double").alias("x_order"),
        *rest,
    )


def chart_series(points: DataFrame, options: ChartOptions) -> DataFrame:
    """Enabled series of aggregated points in long form, rounded half to even.

    ``y`` holds lines, ``low`` and ``high`` bands, and the five box columns a boxplot. The error bar is
    the metric times one plus or minus half the interval.
    """
    def rounded(value: Column) -> Column:
        return round_even(value, options.digits)

    empty = F.lit(None).cast("double")

    def row(kind: str, name: str, y=empty, low=empty, high=empty, box=(empty,) * 5) -> Column:
        parts = zip(("box_min", "box_p25", "box_p50", "box_p75", "box_max"), box, strict=True)
        return F.struct(
            F.lit(kind).alias("series_type"),
            F.lit(name).alias("series_name"),
            y.alias("y"),
            low.alias("low"),
            high.alias("high"),
            *[v.alias(n) for n, v in parts],
        )

    c, rows = F.col, []
    if options.show_boxplot:
        rows.append(row("boxplot", "boxplot", box=tuple(rounded(c(m)) for m in ("min", "p25", "p50", "p75", "max"))))
    if options.show_stdbar:
        rows.append(row("areasplinerange", "mean +- std", low=rounded(c("mean") - c("std")), high=rounded(c("mean") + c("std"))))
    if options.show_ci:
        rows.append(row("areasplinerange", "95% CI", low=rounded(c("mean") - c("ci")), high=rounded(c("mean") + c("ci"))))
    if options.show_errorbar:
        bounds = [c(options.metric) * (1 + options.interval / 2), c(options.metric) * (1 - options.interval / 2)]
        name = f"{options.metric} +- {options.interval * 100:1.1f}%"
        rows.append(row("errorbar", name, low=rounded(F.least(*bounds)), high=rounded(F.greatest(*bounds))))
    if options.show_mean:
        rows.append(row("line", "mean", y=rounded(c("mean"))))
    if options.show_median:
        rows.append(row("line", "median", y=rounded(c("median"))))
    return points.select("chart", "series", "x", "x_order", F.explode(F.array(*rows)).alias("s")).select(
        "chart", "series", "x", "x_order", "s.*"
    )


def chart_view(reports: DataFrame, mapping: FieldMapping, options: ChartOptions, required: bool = False) -> DataFrame:
    """Time-series or scale view as one long table, ordered for drawing.

    All charts and series come from one grouped aggregate over the keys. With ``required``, filters that leave no
    report are an error at once; this looks for one report first.
    """
    metrics = options.metrics()
    rows, keys = charted(reports, mapping, options)
    if required:
        require_rows(rows, options.filters)
    points = titled(point_stats(rows, keys, "y", metrics), mapping, options)
    return chart_series(points, options).orderBy("chart", "series", "x_order", "x", "series_name")


def chart_members(reports: DataFrame, mapping: FieldMapping, options: ChartOptions) -> DataFrame:
    """Commits and report ids behind every point, as rows."""
    rows, keys = charted(reports, mapping, options)
    found = point_members(rows, keys, {"commit": "commit", "_id": "_id"})
    return titled(found, mapping, options).drop("x_order")


def series_sizes(reports: DataFrame, mapping: FieldMapping, options: ChartOptions) -> DataFrame:
    """Number of points of every series of a chart."""
    rows, keys = charted(reports, mapping, options)
    points = titled(rows.select(*[F.col(quoted(k)) for k in keys]).distinct(), mapping, options)
    return points.groupBy("chart", "series").agg(F.count(F.lit(1)).alias("size"))


def require_rows(df: DataFrame, filters: dict | None = None) -> DataFrame:
    if df.isEmpty():
        raise EmptyResultError(f"no results for the filters {filters or {}}")
    return df


def frame_rows(
    reports: DataFrame, selected: DataFrame | None, columns: list[Column], unwind: str = "timers", filters: dict | None = None
) -> DataFrame:
    """Timers of the selected reports, one row each: the columns, ``name``, ``path``, ``duration``, ``_id``.

    The selection is a semi join before the unwinding. A timer without a path gets its name for one.
    """
    chosen = reports.where(equal_to(filters or {}))
    if selected is not None:
        chosen = members(chosen, "_id", selected)
    rows = chosen.select("_id", *columns, F.explode(unwind).alias("timer"))
    others = [c for c in rows.columns if c not in ("_id", "timer")]
    return rows.select(
        "_id",
        *[F.col(quoted(c)) for c in others],
        F.col("timer.name").alias("name"),
        F.coalesce(F.col("timer.path"), F.col("timer.name")).alias("path"),
        F.col("timer.duration").alias("duration"),
    )


def small_labels(below: float) -> tuple[Column, Column]:
    """Name and path shown for everything under the bound."""
    return F.lit(SMALL_NAME % f"{below:g}"), F.lit(SMALL_PATH % f"{below:g}")


def frame_view(
    rows: DataFrame, series: list[str], below: float = 0.5, digits: int = 3
) -> DataFrame:
    """Quartile range per frame and series: ``low``, ``high`` and the path; rows with a zero are dropped.

    Values under the bound count as one frame, the sum of their means. The path is that of the
    smallest report id. Both parts come from one aggregate per frame, so the timers are read once.
    """
    columns = [F.col(quoted(k)) for k in series]
    known = no_null_keys(rows, [*series, "name"])
    duration = F.col("duration")
    split = known.withColumn("large", F.when(duration >= below, duration))
    place = F.when(duration >= below, F.struct(F.col("_id"), F.col("path")))
    aggregates = [
        F.avg(F.when(duration < below, duration)).alias("small"),
        F.min_by("path", place).alias("path"),
    ]
    quartiles = {"low": 0.25, "high": 0.75}
    frames = aggregate_with_percentiles(split, [*series, "name"], aggregates, "large", quartiles)

    small_name, small_path = small_labels(below)
    nothing = F.lit(None).cast("double")
    shown = F.array_compact(
        F.array(
            F.when(F.col("low").isNotNull(), F.struct("name", "path", "low", "high", nothing.alias("small"))),
            F.when(
                F.col("small").isNotNull(),
                F.struct(
                    small_name.alias("name"), small_path.alias("path"), nothing.alias("low"), nothing.alias("high"), F.col("small")
                ),
            ),
        )
    )
    merged = (
        frames.select(*columns, F.explode(shown).alias("f"))
        .groupBy(*columns, "f.name", "f.path")
        .agg(F.max("f.low").alias("low"), F.max("f.high").alias("high"), F.sum("f.small").alias("small"))
    )
    result = merged.select(
        *columns,
        "name",
        "path",
        round_even(F.coalesce("low", "small"), digits).alias("low"),
        round_even(F.coalesce("high", "small"), digits).alias("high"),
    )
    return result.where(no_zero_cell(F.col("low"), F.col("high"))).orderBy(*columns, F.desc("high"), "name")


def frame_scatter(rows: DataFrame, series: list[str], below: float = 0.5, digits: int = 3) -> DataFrame:
    """Single values of every frame from the bound up, largest first, and one row for all the smaller ones."""
    columns = [F.col(quoted(k)) for k in series]
    known = no_null_keys(rows, [*series, "name"])
    large = known.where(F.col("duration") >= below).select(*columns, "name", "path", "duration")
    small_name, small_path = small_labels(below)
    bucket = small_values(known, series, "name", "duration", below).select(
        *columns, small_name.alias("name"), small_path.alias("path"), "duration"
    )
    points = large.unionByName(bucket).select(
        *columns, "name", "path", round_even(F.col("duration"), digits).alias("x")
    )
    return points.where(no_zero_cell(F.col("x"))).orderBy(*columns, F.desc("x"), "name")


def top_frames(rows: DataFrame, n: int = 50) -> DataFrame:
    """The frames with the largest mean duration."""
    means = rows.where("name is not null").groupBy("name").agg(F.avg("duration").alias("mean"))
    return means.orderBy(F.desc("mean"), "name").limit(n)


def commit_history(history: DataFrame, reports: DataFrame, commit: str, time: str, value: str) -> DataFrame:
    """Stored history without its configuration; while there is none, statistics over the reports."""
    if not history.isEmpty():
        return history.drop("config")
    stats = commit_stats(reports, commit, time, value)
    empty = F.create_map().cast("map<string,string>")
    return stats.withColumns({"variables": empty, "config": F.lit(None).cast("string")})
