"""Aggregations of measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.dates import human_interval
from runledger.functions.tails import t_critical
from runledger.functions.text import code_point
from runledger.operators.ordering import running_total
from runledger.operators.quantiles import aggregate_with_percentiles, group_percentiles
from runledger.sizing import keyed_join, quoted

QUANTILES = {"median": 0.5, "p25": 0.25, "p50": 0.5, "p75": 0.75}
METRICS = ("n", "mean", "median", "min", "max", "std", "p25", "p50", "p75", "ci")


def no_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Leave out rows with a null group key, as data-frame grouping does."""
    return df.where(reduce(lambda a, k: a & F.col(quoted(k)).isNotNull(), keys, F.lit(True)))


def point_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """The chosen metrics of ``value`` per group; rows with a null key are left out.

    ``std`` is the sample deviation and ``ci`` the half-width of the 95 % interval of the mean; both
    are null for a single value. Only what the metrics need is computed.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    columns = [F.col(quoted(k)) for k in keys]
    v = F.col(quoted(value)).cast("double")
    rows = no_null_keys(df, keys)
    plain = {
        "n": F.count(v),
        "mean": F.avg(v),
        "min": F.min(v),
        "max": F.max(v),
        "std": F.stddev_samp(v),
    }
    needed = [m for m in plain if m in metrics or ("ci" in metrics and m in ("n", "std"))]
    probabilities = {m: QUANTILES[m] for m in metrics if m in QUANTILES}
    aggregates = [plain[m].alias(m) for m in needed or ["n"]]
    if probabilities:
        stats = aggregate_with_percentiles(rows, keys, aggregates, value, probabilities)
    else:
        stats = rows.groupBy(*columns).agg(*aggregates)
    if "ci" in metrics:
        stats = stats.withColumn("ci", ci_half_width(F.col("n"), F.col("std")))
    return stats.select(*columns, *metrics)


def ci_half_width(n: Column, std: Column, confidence: float = 0.95) -> Column:
    """Standard error of the mean times the critical value of t; null below two values."""
    return std / F.sqrt(n) * t_critical(n - 1, confidence)


def commit_stats(df: DataFrame, commit: str, time: str, value: str) -> DataFrame:
    """Totals per commit and second, newest first; a null commit is a group of its own."""
    v = F.col(quoted(value))
    return (
        df.groupBy(
            F.col(quoted(commit)).alias("hash"),
            F.date_format(F.col(quoted(time)), "yyyy-MM-dd HH:mm:ss").alias("date"),
        )
        .agg(
            F.coalesce(F.sum(v), F.lit(0.0)).alias("dur_sum"),
            F.avg(v).alias("dur_avg"),
            F.max(v).alias("dur_max"),
            F.min(v).alias("dur_min"),
            F.count(F.lit(1)).alias("items"),
        )
        .orderBy(F.desc("date"), "hash")
    )


def point_members(df: DataFrame, keys: list[str], members: dict[str, str]) -> DataFrame:
    """The distinct members of every point as rows ``(keys, kind, member)``.

    A popular point can have any number of members, so they are rows and never one list.
    """
    columns = [F.col(quoted(k)) for k in keys]
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(quoted(c)).cast("string").alias("member")) for kind, c in members.items()]
    )
    rows = no_null_keys(df, keys).select(*columns, F.explode(pairs).alias("pair"))
    return rows.select(*columns, "pair.kind", "pair.member").where("member is not null").distinct()


def small_values(df: DataFrame, keys: list[str], name: str, value: str, below: float) -> DataFrame:
    """One row per group: the sum over names of the mean of the values under the bound."""
    columns = [F.col(quoted(k)) for k in keys]
    means = (
        no_null_keys(df, [*keys, name])
        .where(F.col(quoted(value)) < below)
        .groupBy(*columns, F.col(quoted(name)))
        .agg(F.avg(quoted(value)).alias("mean"))
    )
    return means.groupBy(*columns).agg(F.sum("mean").alias(value))


# Aggregates a configuration may ask for by name, as a fixed list.
NAMED_AGGREGATES = {
    "mean": F.avg,
    "average": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_pop,
    "var": F.var_pop,
}


def extra_variables(
    df: DataFrame, keys: list[str], variables: list[dict[str, str]], order: str
) -> DataFrame:
    """One column per extra variable ``{from, to, via}``; ``via`` is ``first`` or a named aggregate.

    ``first`` takes the value of the row that is first by ``order``. Values to be listed (``push``)
    are rows of :func:`pushed_values`, as a list has no bound.
    """
    columns = [F.col(quoted(k)) for k in keys]
    aggregates, medians = [], {}
    for variable in variables:
        source, via = variable["from"], variable.get("via", "first")
        target = variable.get("to", source)
        if via == "push":
            continue
        if via == "first":
            aggregates.append(F.min_by(quoted(source), quoted(order)).alias(target))
        elif via == "median":
            medians[target] = source
        elif via in NAMED_AGGREGATES:
            aggregates.append(NAMED_AGGREGATES[via](quoted(source)).alias(target))
        else:
            raise ValueError(f"unknown aggregate {via!r}")
    rows = no_null_keys(df, keys)
    result = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("items"), *aggregates)
    for target, source in medians.items():
        part = group_percentiles(rows, keys, source, {target: 0.5})
        result = keyed_join(result, part, keys, "left")
    return result


def pushed_values(df: DataFrame, keys: list[str], variables: list[dict[str, str]]) -> DataFrame:
    """Every value of the ``push`` variables as rows ``(keys, variable, value)``."""
    columns = [F.col(quoted(k)) for k in keys]
    pushed = [v for v in variables if v.get("via") == "push"]
    pairs = F.array(
        *[
            F.struct(
                F.lit(v.get("to", v["from"])).alias("variable"), F.col(quoted(v["from"])).cast("string").alias("value")
            )
            for v in pushed
        ]
    )
    rows = no_null_keys(df, keys).select(*columns, F.explode(pairs).alias("pair"))
    return rows.select(*columns, "pair.variable", "pair.value")


def geometric_mean(value: Column) -> Column:
    """Through logarithms: zero if a value is zero, and null if one is negative and none zero."""
    mean = F.exp(F.avg(F.when(value > 0, F.ln(value))))
    return F.when(F.bool_or(value == 0), 0.0).when(F.min(value) > 0, mean)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(quoted(column)).isNotNull())
        .groupBy(F.col(quoted(column)).alias("value"))
        .agg(F.count(F.lit(1)).alias("items"))
        .orderBy(F.desc("items"), "value")
    )


def with_group_bounds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add the group's ``low`` and ``high``; aggregated and joined back, so a hot group stays split."""
    columns = [F.col(quoted(k)) for k in keys]
    v = F.col(quoted(value))
    bounds = df.groupBy(*columns).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return keyed_join(df, bounds, keys)


def minmax_scale(df: DataFrame, keys: list[str], value: str, name: str = "scaled") -> DataFrame:
    """Scale to [0, 1] within the group; null where the group has no range."""
    bounded = with_group_bounds(df, keys, value)
    scaled = F.try_divide(F.col(quoted(value)) - F.col("low"), F.col("high") - F.col("low"))
    return bounded.withColumn(name, scaled).drop("low", "high")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 11) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value; the last bin is closed."""
    columns = [F.col(quoted(k)) for k in keys]
    bounded = with_group_bounds(no_null_keys(df, [*keys, value]), keys, value)
    width = (F.col("high") - F.col("low")) / bins
    placed = F.floor(F.try_divide(F.col(quoted(value)) - F.col("low"), width)) + 1
    numbered = bounded.withColumn("bin", F.least(F.coalesce(placed, F.lit(1)), F.lit(bins)).cast("int"))
    return numbered.groupBy(*columns, "bin").agg(
        F.count(F.lit(1)).alias("items"), F.first("low").alias("low"), F.first("high").alias("high")
    )


def squeeze(df: DataFrame, series: list[str], x: str, n: int) -> DataFrame:
    """Join every ``n`` neighbouring x values of a series in one labelled group.

    Adds ``squeeze_no`` (from 0) and ``squeeze_label``. The distinct x values are numbered, not the rows.
    """
    columns = [F.col(quoted(k)) for k in series]
    xs = no_null_keys(df, [*series, x]).select(*columns, F.col(quoted(x)).alias("__x")).distinct()
    numbered = running_total(xs, series, [F.col("__x")], name="__no")
    grouped = numbered.select(*columns, "__x", F.floor((F.col("__no") - 1) / F.lit(n)).alias("squeeze_no"))
    spans = grouped.groupBy(*columns, "squeeze_no").agg(
        F.min("__x").alias("first_x"), F.max("__x").alias("last_x"), F.count(F.lit(1)).alias("items")
    )
    first, last, items = F.col("first_x"), F.col("last_x"), F.col("items")
    letter = code_point(F.lit(65) + F.col("squeeze_no") % 55_000)
    if dict(df.dtypes)[x].startswith("timestamp"):
        one = F.format_string("group %s (1 item, %s)", letter, F.date_format(first, "yyyy-MM-dd HH:mm:ss"))
        many = F.format_string("group %s (%d items, period of %s)", letter, items, human_interval(first, last))
    else:
        one = F.format_string("group %s (1 item, %s)", letter, first.cast("string"))
        many = F.format_string("group %s (%d items, %s - %s)", letter, items, first.cast("string"), last.cast("string"))
    labels = spans.withColumn("squeeze_label", F.when(first == last, one).otherwise(many))
    lookup = keyed_join(grouped, labels, [*series, "squeeze_no"]).select(
        *columns, F.col("__x").alias(x), "squeeze_no", "squeeze_label"
    )
    return keyed_join(df, lookup, [*series, x])
