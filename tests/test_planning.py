import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from runledger.operators import aggregates, design, history
from runledger.plans import options, views
from runledger.sources import tables


@pytest.mark.parametrize(
    ("spec", "want"),
    [(None, (1, False)), (5, (5, False)), ({"exactly": 10}, (10, False)), ({"exactly": 10, "no-less-than": 15}, (15, True)), ({"no-less-than": 15}, (15, True)), (0, (1, False))],
)
def test_repeat_spec(spec, want):
    assert design.repeat_spec(spec) == want


@pytest.mark.parametrize("spec", [{}, True, "x"])
def test_bad_repeat_spec(spec):
    with pytest.raises(ValueError):
        design.repeat_spec(spec)


def test_matrix_order_and_position(spark):
    df = spark.createDataFrame([("s",)], "section string")
    rows = design.matrix(df, {"a": F.array(F.lit(1), F.lit(2)), "b": F.array(F.lit("x"), F.lit("y"), F.lit("z"))}).orderBy("current").collect()
    assert [(r["a"], r["b"], r["current"], r["total"]) for r in rows] == [
        (1, "x", 1, 6), (1, "y", 2, 6), (1, "z", 3, 6), (2, "x", 4, 6), (2, "y", 5, 6), (2, "z", 6, 6)
    ]


def test_zip_and_unequal_lists(spark):
    df = spark.createDataFrame([([1, 2], ["m", "n"])], "cpu array<int>, mesh array<string>")
    rows = design.zipped(df, {"c": F.col("cpu"), "m": F.col("mesh")}, {"fixed": F.lit(7)}).orderBy("current").collect()
    assert [(r["c"], r["m"], r["fixed"], r["current"], r["total"]) for r in rows] == [(1, "m", 7, 1, 2), (2, "n", 7, 2, 2)]
    uneven = spark.createDataFrame([([1, 2], ["m"])], "cpu array<int>, mesh array<string>")
    with pytest.raises(Exception, match="differ in length"):
        design.zipped(uneven, {"c": F.col("cpu"), "m": F.col("mesh")}).collect()


def test_remaining_and_tasks(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    found = spark.createDataFrame([("a", 2), ("b", 9), (None, 1)], "k string, found bigint")
    got = {r["k"]: r["remaining"] for r in design.remaining_runs(plan, found, ["k"], {"no-less-than": 3}).collect()}
    assert got == {"a": 1, "b": 0, "c": 3, None: 2}
    fixed = design.remaining_runs(plan, found, ["k"], 2)
    assert {r["remaining"] for r in fixed.collect()} == {2}
    tasks = design.run_tasks(design.remaining_runs(plan, found, ["k"], {"no-less-than": 3}))
    assert sorted((r["k"] or "", r["repetition"]) for r in tasks.collect()) == [("", 1), ("", 2), ("a", 1), ("c", 1), ("c", 2), ("c", 3)]


def test_effort_without_history_is_unknown(spark):
    df = spark.createDataFrame([("a", 4, 20.0), ("b", 0, 0.0)], "k string, reps int, duration double")
    got = {r["k"]: (r["remaining"], r["seconds_left"]) for r in design.effort_estimate(df, ["k"], "reps", "duration", 10).collect()}
    assert got == {"a": (6, 30.0), "b": (10, None)}


def test_commit_per_day_takes_consecutive_runs(spark):
    days = ["3", "3", "2", "3", "1", "1", "1"]
    df = spark.createDataFrame([("m", i, d) for i, d in enumerate(days)], "b string, pos int, day string")
    got = history.pick_commits(df, ["b"], [F.col("pos")], "day", "commit-per-day")
    assert sorted(r["pos"] for r in got.collect()) == [0, 2, 3, 4]
    assert history.pick_commits(df, ["b"], [F.col("pos")], "day").count() == 7
    with pytest.raises(ValueError):
        history.pick_commits(df, ["b"], [], "day", "weekly")


def test_active_branches(spark):
    df = spark.createDataFrame([("old", dt.datetime(2020, 1, 1)), ("new", dt.datetime(2020, 8, 1)), ("edge", dt.datetime(2020, 2, 1))], "b string, t timestamp_ntz")
    assert sorted(r["b"] for r in history.active_branches(df, "b", "t", dt.datetime(2020, 8, 1)).collect()) == ["edge", "new"]


def test_commit_stats_keeps_null_commits_and_sums_nothing_to_zero(spark):
    rows = [(None, dt.datetime(2020, 1, 1), 2.0), ("a", dt.datetime(2020, 1, 2), None)]
    got = aggregates.commit_stats(spark.createDataFrame(rows, "c string, t timestamp_ntz, v double"), "c", "t", "v").collect()
    assert [(r["hash"], r["dur_sum"], r["dur_avg"], r["items"]) for r in got] == [("a", 0.0, None, 1), (None, 2.0, 2.0, 1)]


def test_squeeze_labels(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(days=d)) for d in (0, 0, 1, 3, 3, 9)]
    df = spark.createDataFrame(rows, "k string, x timestamp_ntz")
    got = {(r["squeeze_no"], r["squeeze_label"]) for r in aggregates.squeeze(df, ["k"], "x", 3).collect()}
    assert got == {(0, "group A (3 items, period of 3 days)"), (1, "group B (1 item, 2024-01-10 00:00:00)")}
    text = spark.createDataFrame([("s", "1"), ("s", "10"), ("s", "2")], "k string, x string")
    got = {(r["x"], r["squeeze_label"]) for r in aggregates.squeeze(text, ["k"], "x", 2).collect()}
    assert got == {("1", "group A (2 items, 1 - 10)"), ("10", "group A (2 items, 1 - 10)"), ("2", "group B (1 item, 2)")}


def test_options():
    assert options.ChartOptions.dashboard().metrics() == ("mean", "median", "ci")
    assert options.ChartOptions().metrics() == ("mean",)
    with pytest.raises(options.NoSeriesError):
        options.ChartOptions(show_mean=False).metrics()
    asked = options.ChartOptions.from_request({"show-mean": False, "show-boxplot": True, "squeeze": {"value": "4"}, "range": {"from": "1", "to": "2"}, "groupby": {"a": True, "b": False}})
    assert (asked.show_mean, asked.show_boxplot, asked.squeeze, asked.time_range, asked.split_charts_by) == (False, True, 4, (1, 2), ("a",))


def small_reports(spark):
    rows = [(i, ("t", 1 + i % 2, "1_7_el", 100, 0), (float(i), 0), ("m", "c", dt.datetime(2024, 1, 1 + i % 2)), None) for i in range(8)]
    schema = """_id bigint, problem struct<`test-name`:string, cpu:int, mesh:string, `task-size`:bigint, weak:int>,
        result struct<duration:double, returncode:int>, git struct<branch:string, commit:string, datetime:timestamp_ntz>,
        timers array<struct<name:string, path:string, duration:double>>"""
    return spark.createDataFrame(rows, schema)


def test_chart_view_defaults_round_to_two_digits(spark):
    mapping = replace(tables.COARSE_MAPPING)
    got = views.chart_view(small_reports(spark), mapping, options.ChartOptions(show_errorbar=True)).collect()
    bars = [r for r in got if r["series_type"] == "errorbar"]
    assert {r["series_name"] for r in bars} == {"mean +- 2.5%"}
    assert all(r["low"] <= r["high"] for r in bars)
    lines = {(r["series"], r["x"]): r["y"] for r in got if r["series_type"] == "line"}
    assert lines == {("scale=strong, cpu=1, test=t", "2024-01-01 00:00:00"): 3.0, ("scale=strong, cpu=2, test=t", "2024-01-02 00:00:00"): 4.0}
    assert {r["chart"] for r in got} == {"*"}


def test_view_is_the_same_each_time(spark):
    asked = options.ChartOptions.dashboard(show_boxplot=True, squeeze=2)
    args = (small_reports(spark), tables.COARSE_MAPPING, asked)
    assert views.chart_view(*args).collect() == views.chart_view(*args).collect()


def test_empty_result(spark):
    asked = options.ChartOptions(filters={"problem.test": "none"})
    rows = views.selected_reports(small_reports(spark), tables.COARSE_MAPPING, asked)
    with pytest.raises(options.EmptyResultError):
        views.require_rows(rows, asked.filters)
    with pytest.raises(options.EmptyResultError):
        views.chart_view(small_reports(spark), tables.COARSE_MAPPING, asked, required=True)
    assert views.chart_view(small_reports(spark), tables.COARSE_MAPPING, asked).count() == 0


def test_bad_mapping_and_mode(spark):
    with pytest.raises(ValueError):
        options.FieldMapping({"problem.unknown": "x"})
    with pytest.raises(ValueError):
        views.chart_view(small_reports(spark), tables.COARSE_MAPPING, options.ChartOptions(mode="pie"))


def test_frame_view_small_values_and_zeros(spark):
    rows = [(1, "a", "/a", 0.2), (2, "a", "/a", 0.4), (3, "b", "/b", 0.1), (4, "big", "/x", 3.0), (5, "big", "/w", 5.0)]
    df = spark.createDataFrame([("s", *r) for r in rows], "series string, _id bigint, name string, path string, duration double")
    got = {r["name"]: (r["low"], r["high"], r["path"]) for r in views.frame_view(df, ["series"]).collect()}
    assert got["big"] == (3.5, 4.5, "/x")
    assert got["below 0.5 s"][:2] == (0.4, 0.4)
    assert set(got) == {"big", "below 0.5 s"}
    points = [(r["name"], r["x"]) for r in views.frame_scatter(df, ["series"]).collect()]
    assert points == [("big", 5.0), ("big", 3.0), ("below 0.5 s", 0.4)]
    zeros = df.withColumn("duration", F.lit(0.0))
    assert views.frame_view(zeros, ["series"]).count() == 0
