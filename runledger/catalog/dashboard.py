"""The dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.aggregation import flat, rounded
from runledger.catalog.registry import REPORTS, TIMERS, query, t_critical_sql
from runledger.plans import views
from runledger.plans.options import SCALE_VIEW, ChartOptions
from runledger.sources import tables

# Views are built with full digits and compared with eight, instead of the chart's two: ties at two
# digits hang on the last bit of a mean.
BUILT, DIGITS = 15, 8


def chart_sql(keys: str, x: str, x_order: str, charts: list[str], where: str = "true", ci: bool = True) -> str:
    stats = f"""WITH RECURSIVE {REPORTS},
    pts AS (SELECT {keys}, {x} AS x, {x_order} AS x_order, count(duration) AS n, avg(duration) AS mean, median(duration) AS med,
      min(duration) AS mn, max(duration) AS mx, stddev_samp(duration) AS std, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3
      FROM reports WHERE {where} GROUP BY ALL)"""
    if ci:
        stats += f""", {t_critical_sql("pts")},
    full_pts AS (SELECT *, std / sqrt(n) * t AS ci FROM pts LEFT JOIN tcrit USING (n))"""
    source = "full_pts" if ci else "pts"
    nothing = {c: "NULL::DOUBLE" for c in ("y", "low", "high", "box_min", "box_p25", "box_p50", "box_p75", "box_max")}
    known = {
        "mean": ("line", "mean", {"y": "mean"}),
        "median": ("line", "median", {"y": "med"}),
        "ci": ("areasplinerange", "95% CI", {"low": "mean - ci", "high": "mean + ci"}),
        "std": ("areasplinerange", "mean +- std", {"low": "mean - std", "high": "mean + std"}),
        "errorbar": ("errorbar", "median +- 2.5%", {"low": "med * 0.9875", "high": "med * 1.0125"}),
        "boxplot": ("boxplot", "boxplot", {"box_min": "mn", "box_p25": "q1", "box_p50": "med", "box_p75": "q3", "box_max": "mx"}),
    }
    parts = []
    for chart in charts:
        kind, name, columns = known[chart]
        digits = 6 if chart == "ci" else DIGITS
        values = {**nothing, **{c: f"round({e}, {digits})" for c, e in columns.items()}}
        listed = ", ".join(f"{e} AS {c}" for c, e in values.items())
        parts.append(f"SELECT chart, series, x, x_order, '{kind}' AS series_type, '{name}' AS series_name, {listed} FROM {source}")
    return stats + "\n" + "\nUNION ALL\n".join(parts)


def compared(view):
    """Eight digits, six for intervals, whose critical values are computed in two ways."""
    is_ci = F.col("series_name") == "95% CI"
    band = {c: F.when(is_ci, F.round(c, 6)).otherwise(F.round(c, DIGITS)) for c in ("low", "high")}
    rest = {c: F.round(c, DIGITS) for c in view.columns if c == "y" or c.startswith("box_")}
    return view.withColumns({**band, **rest})


@query(
    "time_series_view",
    chart_sql(
        "'test=' || test AS chart, 'scale=' || scale || ', cpu=' || cpu AS series",
        "strftime(dt, '%Y-%m-%d %H:%M:%S')",
        "epoch(dt)::DOUBLE",
        ["ci", "errorbar", "median"],
    ),
)
def time_series_view(spark, sf_dir):
    options = ChartOptions.dashboard(split_charts_by=("problem.test",), digits=BUILT)
    return compared(views.chart_view(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options))


@query(
    "time_series_filtered",
    chart_sql(
        "'test=' || test AS chart, 'scale=' || scale || ', cpu=' || cpu AS series",
        "strftime(dt, '%Y-%m-%d %H:%M:%S')",
        "epoch(dt)::DOUBLE",
        ["mean"],
        "test = 'view' AND dt BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
        ci=False,
    ),
)
def time_series_filtered(spark, sf_dir):
    request = {
        "mode": {"mode": "time-series"},
        "squeeze": {"value": "1"},
        "range": {"from": "1704412800", "to": "1705708800"},
        "filters": {"problem.test": "view", "git.branch": "*", "problem.cpu": ""},
        "groupby": {"problem.test": True, "problem.cpu": False},
    }
    from dataclasses import replace

    options = replace(ChartOptions.from_request(request), digits=BUILT)
    return compared(views.chart_view(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options))


@query(
    "scale_view",
    chart_sql(
        "'commit=' || commit AS chart, 'scale=' || scale AS series",
        "cpu::VARCHAR",
        "cpu::DOUBLE",
        ["mean", "std", "boxplot"],
        ci=False,
    ),
)
def scale_view(spark, sf_dir):
    options = ChartOptions(
        mode=SCALE_VIEW, show_stdbar=True, show_boxplot=True, split_charts_by=("git.commit",), digits=DIGITS
    )
    return compared(views.chart_view(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options))


@query(
    "chart_series",
    chart_sql(
        "'*' AS chart, 'scale=' || scale || ', cpu=' || cpu || ', test=' || test AS series",
        "strftime(dt, '%Y-%m-%d %H:%M:%S')",
        "epoch(dt)::DOUBLE",
        ["boxplot", "std", "ci", "errorbar", "mean", "median"],
    ),
)
def chart_series(spark, sf_dir):
    """Every kind of series at once."""
    options = ChartOptions.dashboard(show_mean=True, show_stdbar=True, show_boxplot=True, digits=BUILT)
    return compared(views.chart_view(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options))


@query(
    "squeezed_view",
    f"""WITH {REPORTS}, r AS (SELECT *, 'test=' || test AS chart, 'scale=' || scale || ', cpu=' || cpu AS series FROM reports),
    xs AS (SELECT DISTINCT chart, series, dt FROM r),
    g AS (SELECT *, ((row_number() OVER (PARTITION BY chart, series ORDER BY dt) - 1) // 3)::BIGINT AS no FROM xs),
    spans AS (SELECT chart, series, no, min(dt) AS b, max(dt) AS e, count(*) AS n FROM g GROUP BY ALL),
    labels AS (SELECT chart, series, no, CASE WHEN b = e THEN 'group ' || chr((65 + no)::INT) || ' (1 item, ' || strftime(b, '%Y-%m-%d %H:%M:%S') || ')'
      ELSE 'group ' || chr((65 + no)::INT) || ' (' || n || ' items, period of ' || date_diff('day', b, e) || ' day' ||
           CASE WHEN date_diff('day', b, e) > 1 THEN 's' ELSE '' END || ')' END AS label FROM spans)
    SELECT r.chart, r.series, label AS x, g.no::DOUBLE AS x_order, 'line' AS series_type, 'median' AS series_name, round(median(duration), {DIGITS}) AS y,
      NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS box_min, NULL::DOUBLE AS box_p25, NULL::DOUBLE AS box_p50, NULL::DOUBLE AS box_p75, NULL::DOUBLE AS box_max
    FROM r JOIN g USING (chart, series, dt) JOIN labels l ON l.chart = r.chart AND l.series = r.series AND l.no = g.no GROUP BY ALL""",
)
def squeezed_view(spark, sf_dir):
    options = ChartOptions(
        show_mean=False, show_median=True, squeeze=3, split_charts_by=("problem.test",), digits=DIGITS
    )
    return compared(views.chart_view(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options))


@query(
    "chart_members",
    f"""WITH {REPORTS}, r AS (SELECT 'test=' || test AS chart, 'scale=' || scale || ', cpu=' || cpu AS series,
      strftime(dt, '%Y-%m-%d %H:%M:%S') AS x, commit, id FROM reports)
    SELECT DISTINCT chart, series, x, 'commit' AS kind, commit AS member FROM r
    UNION ALL SELECT DISTINCT chart, series, x, '_id', id::VARCHAR FROM r""",
)
def chart_members(spark, sf_dir):
    options = ChartOptions.dashboard(split_charts_by=("problem.test",))
    return views.chart_members(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options)


@query(
    "series_sizes",
    f"""WITH {REPORTS} SELECT 'test=' || test AS chart, 'scale=' || scale || ', cpu=' || cpu AS series, count(DISTINCT dt) AS size FROM reports GROUP BY ALL""",
)
def series_sizes(spark, sf_dir):
    options = ChartOptions.dashboard(split_charts_by=("problem.test",))
    return views.series_sizes(tables.reports(spark, sf_dir), tables.COARSE_MAPPING, options)


def drilled(spark, sf_dir):
    """Timers of the reports behind the points of one week."""
    reports = tables.reports(spark, sf_dir)
    selected = reports.where("git.datetime < timestamp_ntz '2024-01-15 00:00:00'").select("_id")
    columns = [F.col("problem.cpu").alias("cpus"), F.expr("if(problem.weak = 1, 'weak', 'strong')").alias("scale")]
    return views.frame_rows(reports, selected, columns)


FRAMES_SQL = f"""WITH {TIMERS}, t AS (SELECT cpu AS cpus, scale, name, coalesce(path, name) AS path, seconds AS d, id FROM timers WHERE dt < TIMESTAMP '2024-01-15'),
    bucket AS (SELECT cpus, scale, sum(m) AS d FROM (SELECT cpus, scale, name, avg(d) AS m FROM t WHERE d < 0.5 GROUP BY ALL) GROUP BY ALL),
    every AS (SELECT cpus, scale, name, path, d, id FROM t WHERE d >= 0.5
      UNION ALL SELECT cpus, scale, 'below 0.5 s', 'parts with a mean below 0.5 s, added up', d, NULL FROM bucket)"""


@query(
    "frame_view",
    f"""{FRAMES_SQL}, f AS (SELECT cpus, scale, name, arg_min(path, coalesce(id, -1)) AS path, round(quantile_cont(d, 0.25), {DIGITS}) AS low, round(quantile_cont(d, 0.75), {DIGITS}) AS high
      FROM every GROUP BY cpus, scale, name)
    SELECT * FROM f WHERE low <> 0 AND high <> 0""",
)
def frame_view(spark, sf_dir):
    return rounded(views.frame_view(drilled(spark, sf_dir), ["cpus", "scale"], digits=BUILT))


@query(
    "frame_scatter",
    f"""{FRAMES_SQL} SELECT cpus, scale, name, path, round(d, {DIGITS}) AS x FROM every WHERE round(d, {DIGITS}) <> 0""",
)
def frame_scatter(spark, sf_dir):
    return rounded(views.frame_scatter(drilled(spark, sf_dir), ["cpus", "scale"], digits=BUILT))


@query(
    "commit_history",
    f"""WITH {REPORTS} SELECT commit AS hash, strftime(dt, '%Y-%m-%d %H:%M:%S') AS date, round(sum(duration), 6) AS dur_sum, round(avg(duration), 8) AS dur_avg,
      max(duration) AS dur_max, min(duration) AS dur_min, count(*) AS items, 0 AS variables, NULL::VARCHAR AS config FROM reports GROUP BY 1, 2""",
)
def commit_history(spark, sf_dir):
    """Without a stored history the statistics over the reports stand in."""
    reports = flat(spark, sf_dir)
    history = spark.createDataFrame([], "name string, reps int, duration double, config string")
    rows = views.commit_history(history, reports, "commit", "dt", "duration")
    return rows.withColumns({"dur_sum": F.round("dur_sum", 6), "dur_avg": F.round("dur_avg", 8), "variables": F.size("variables")})


@query(
    "commit_history_stored",
    f"""WITH {REPORTS} SELECT commit, test AS name, count(*) AS reps, round(sum(duration), 6) AS duration FROM reports GROUP BY ALL""",
)
def commit_history_stored(spark, sf_dir):
    """A stored history is given without its configuration."""
    reports = flat(spark, sf_dir)
    history = reports.groupBy("commit", F.col("test").alias("name")).agg(
        F.count(F.lit(1)).alias("reps"), F.sum("duration").alias("duration"), F.max("mesh").alias("config")
    )
    return rounded(views.commit_history(history, reports, "commit", "dt", "duration"), digits=6)
