"""Aggregates of measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import REPORTS, TIMERS, WALLTIMES, query, t_critical_sql
from runledger.functions.numbers import logarithm
from runledger.operators import aggregates
from runledger.operators.design import index_counts
from runledger.operators.quantiles import group_percentiles
from runledger.operators.reshape import unwind
from runledger.plans import views
from runledger.sources import tables


def flat(spark, sf_dir):
    return tables.reports(spark, sf_dir).select(
        "_id",
        "started",
        F.col("problem.test-name").alias("test"),
        F.col("problem.cpu").alias("cpu"),
        F.col("problem.mesh").alias("mesh"),
        F.col("result.duration").alias("duration"),
        "git.branch",
        "git.commit",
        F.col("git.datetime").alias("dt"),
    )


def timers(spark, sf_dir):
    rows = unwind(tables.reports(spark, sf_dir))
    return rows.select("_id", F.col("problem.test-name").alias("test"), "timer.name", "timer.path", "timer.duration")


def rounded(df, *keep, digits=8):
    """Round every double that is not listed, for comparison."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in keep else F.col(f"`{n}`") for n, t in df.dtypes
    ])


@query(
    "commit_stats",
    f"""WITH {REPORTS} SELECT commit AS hash, strftime(dt, '%Y-%m-%d %H:%M:%S') AS date, round(coalesce(sum(duration), 0), 6) AS dur_sum,
       round(avg(duration), 8) AS dur_avg, max(duration) AS dur_max, min(duration) AS dur_min, count(*) AS items
       FROM reports GROUP BY 1, 2 ORDER BY date DESC""",
)
def commit_stats(spark, sf_dir):
    stats = aggregates.commit_stats(flat(spark, sf_dir), "commit", "dt", "duration")
    return stats.withColumns({"dur_sum": F.round("dur_sum", 6), "dur_avg": F.round("dur_avg", 8)})


POINT_SQL = f"""WITH RECURSIVE {REPORTS},
stats AS (SELECT test, dt, count(duration) AS n, avg(duration) AS mean, median(duration) AS median, min(duration) AS min, max(duration) AS max,
  stddev_samp(duration) AS std, quantile_cont(duration, 0.25) AS p25, quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.75) AS p75
  FROM reports GROUP BY 1, 2),
{t_critical_sql("stats")}
SELECT test, dt, n, round(mean, 8) AS mean, round(median, 8) AS median, min, max, round(std, 8) AS std, round(p25, 8) AS p25, round(p50, 8) AS p50,
  round(p75, 8) AS p75, round(std / sqrt(n) * t, 6) AS ci FROM stats LEFT JOIN tcrit USING (n)"""


@query("point_stats", POINT_SQL)
def point_stats(spark, sf_dir):
    stats = aggregates.point_stats(flat(spark, sf_dir), ["test", "dt"], "duration")
    return rounded(stats.withColumn("ci", F.round("ci", 6)))


@query("point_stats_spread", POINT_SQL)
def point_stats_spread(spark, sf_dir):
    """Kept under its earlier name: there is one plan for every size now."""
    stats = aggregates.point_stats(flat(spark, sf_dir), ["test", "dt"], "duration")
    return rounded(stats.withColumn("ci", F.round("ci", 6)))


@query(
    "point_members",
    f"""WITH {REPORTS} SELECT test, dt, 'commit' AS kind, commit AS member FROM reports GROUP BY ALL
       UNION ALL SELECT test, dt, '_id', id::VARCHAR FROM reports GROUP BY ALL""",
)
def point_members(spark, sf_dir):
    return aggregates.point_members(flat(spark, sf_dir), ["test", "dt"], {"commit": "commit", "_id": "_id"})


@query(
    "small_value_bucket",
    f"""WITH {TIMERS} SELECT test, round(sum(m), 8) AS duration FROM (SELECT test, name, avg(seconds) AS m FROM timers
       WHERE seconds < 0.5 GROUP BY 1, 2) GROUP BY 1""",
)
def small_value_bucket(spark, sf_dir):
    return rounded(aggregates.small_values(timers(spark, sf_dir), ["test"], "name", "duration", 0.5))


@query(
    "frame_quartiles",
    f"""WITH {TIMERS} SELECT name, round(quantile_cont(seconds, 0.25), 8) AS low, round(quantile_cont(seconds, 0.75), 8) AS high,
       arg_min(coalesce(path, name), id) AS path FROM timers GROUP BY 1""",
)
def frame_quartiles(spark, sf_dir):
    rows = timers(spark, sf_dir)
    ranges = rounded(group_percentiles(rows, ["name"], "duration", {"low": 0.25, "high": 0.75}))
    paths = rows.groupBy("name").agg(F.min_by(F.coalesce("path", "name"), "_id").alias("path"))
    return ranges.join(paths, "name").orderBy(F.desc("high"), "name")


@query(
    "top_frames",
    f"""WITH {TIMERS} SELECT name, round(avg(seconds), 8) AS mean FROM timers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def top_frames(spark, sf_dir):
    return rounded(views.top_frames(timers(spark, sf_dir), 3))


DESCRIBE_SQL = f"""WITH {WALLTIMES} SELECT tag, excl, count(walltime) AS n, round(avg(walltime), 6) AS mean, round(stddev_samp(walltime), 6) AS std,
       round(min(walltime), 6) AS min, round(quantile_cont(walltime, 0.25), 6) AS p25, round(median(walltime), 6) AS p50,
       round(quantile_cont(walltime, 0.75), 6) AS p75, round(max(walltime), 6) AS max FROM walltimes GROUP BY 1, 2"""


@query("describe_groups", DESCRIBE_SQL)
def describe_groups(spark, sf_dir):
    metrics = ("n", "mean", "std", "min", "p25", "p50", "p75", "max")
    return rounded(aggregates.point_stats(tables.walltimes(spark, sf_dir), ["tag", "excl"], "walltime", metrics), digits=6)


@query(
    "boxplot_stats",
    f"""WITH {WALLTIMES} SELECT tag, round(min(walltime), 6) AS min, round(quantile_cont(walltime, 0.25), 6) AS p25, round(median(walltime), 6) AS p50,
       round(quantile_cont(walltime, 0.75), 6) AS p75, round(max(walltime), 6) AS max FROM walltimes GROUP BY 1""",
)
def boxplot_stats(spark, sf_dir):
    metrics = ("min", "p25", "p50", "p75", "max")
    return rounded(aggregates.point_stats(tables.walltimes(spark, sf_dir), ["tag"], "walltime", metrics), digits=6)


@query(
    "mean_sd_band",
    f"""WITH {WALLTIMES} SELECT tag, excl, round(avg(walltime), 6) AS mean, round(avg(walltime) - stddev_samp(walltime), 6) AS low,
       round(avg(walltime) + stddev_samp(walltime), 6) AS high FROM walltimes GROUP BY 1, 2""",
)
def mean_sd_band(spark, sf_dir):
    stats = aggregates.point_stats(tables.walltimes(spark, sf_dir), ["tag", "excl"], "walltime", ("mean", "std"))
    mean, std = F.col("mean"), F.col("std")
    return rounded(stats.select("tag", "excl", "mean", (mean - std).alias("low"), (mean + std).alias("high")), digits=6)


@query(
    "normal_fit",
    f"""WITH {WALLTIMES} SELECT tag, excl, round(avg(walltime), 6) AS mu, round(stddev_pop(walltime), 6) AS sigma FROM walltimes GROUP BY 1, 2""",
)
def normal_fit(spark, sf_dir):
    fit = tables.walltimes(spark, sf_dir).groupBy("tag", "excl")
    return rounded(fit.agg(F.avg("walltime").alias("mu"), F.stddev_pop("walltime").alias("sigma")), digits=6)


@query(
    "histogram_bins",
    f"""WITH {REPORTS}, b AS (SELECT test, duration, min(duration) OVER w AS lo, max(duration) OVER w AS hi FROM reports WINDOW w AS (PARTITION BY test))
       SELECT test, least(coalesce(floor((duration - lo) / nullif((hi - lo) / 11, 0)) + 1, 1), 11)::INT AS bin, count(*) AS items, lo AS low, hi AS high
       FROM b GROUP BY ALL""",
)
def histogram_bins(spark, sf_dir):
    return aggregates.histogram(flat(spark, sf_dir), ["test"], "duration")


@query(
    "minmax_scale",
    f"""WITH {REPORTS} SELECT id AS _id, test, round((duration - min(duration) OVER w) / nullif(max(duration) OVER w - min(duration) OVER w, 0), 8) AS scaled,
       round(ln(duration), 8) AS log, round(log2(duration), 8) AS log_2 FROM reports WINDOW w AS (PARTITION BY test)""",
)
def minmax_scale(spark, sf_dir):
    scaled = aggregates.minmax_scale(flat(spark, sf_dir), ["test"], "duration")
    return rounded(scaled.select("_id", "test", "scaled", logarithm(F.col("duration")).alias("log"), logarithm(F.col("duration"), 2).alias("log_2")))


EXTRA = [
    {"from": "mesh", "to": "first_mesh"},
    {"from": "duration", "to": "mean_duration", "via": "mean"},
    {"from": "duration", "to": "median_duration", "via": "median"},
    {"from": "cpu", "to": "max_cpu", "via": "max"},
    {"from": "duration", "to": "durations", "via": "push"},
]


@query(
    "extra_vars",
    f"""WITH {REPORTS} SELECT commit, count(*) AS items, arg_min(cpu || '_' || size || '_el', id) AS first_mesh, round(avg(duration), 8) AS mean_duration,
       round(median(duration), 8) AS median_duration, max(cpu) AS max_cpu FROM reports GROUP BY 1""",
)
def extra_vars(spark, sf_dir):
    return rounded(aggregates.extra_variables(flat(spark, sf_dir), ["commit"], EXTRA, "_id"))


@query(
    "pushed_values",
    f"""WITH {REPORTS} SELECT commit, 'durations' AS variable, round(duration, 4) AS value FROM reports""",
)
def pushed_values(spark, sf_dir):
    rows = aggregates.pushed_values(flat(spark, sf_dir), ["commit"], EXTRA)
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(
    "geometric_mean",
    f"""WITH {WALLTIMES} SELECT tag, round(exp(avg(ln(walltime))), 6) AS gmean,
       CASE WHEN min(walltime_mem_l2) > 0 THEN round(exp(avg(ln(nullif(walltime_mem_l2, 0)))), 6) ELSE 0.0::DOUBLE END AS gmean_l2 FROM walltimes GROUP BY 1""",
)
def geometric_mean(spark, sf_dir):
    gmean = aggregates.geometric_mean
    rows = tables.walltimes(spark, sf_dir).groupBy("tag")
    return rounded(rows.agg(gmean(F.col("walltime")).alias("gmean"), gmean(F.col("walltime_mem_l2")).alias("gmean_l2")), digits=6)


@query(
    "index_counts",
    f"""WITH {REPORTS} SELECT commit, test, cpu, count(*) AS found FROM reports GROUP BY ALL""",
)
def index_count(spark, sf_dir):
    return index_counts(flat(spark, sf_dir), ["commit", "test", "cpu"])


@query(
    "value_counts",
    f"""WITH {REPORTS} SELECT cpu AS value, count(*) AS items FROM reports GROUP BY 1""",
)
def value_counts(spark, sf_dir):
    return aggregates.value_counts(flat(spark, sf_dir), "cpu")


@query("sorted_distinct", f"""WITH {REPORTS} SELECT DISTINCT size AS value FROM reports""")
def sorted_distinct(spark, sf_dir):
    size = F.split("mesh", "_")[1].cast("int").alias("value")
    return flat(spark, sf_dir).select(size).distinct().orderBy("value")
