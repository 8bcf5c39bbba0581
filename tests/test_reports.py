"""Report shaping, filters and scalar expressions on small literal frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runledger.functions import dates, numbers, text
from runledger.operators import filters, reshape, tree
from runledger.sources import reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("tag", "name"),
    [
        ("MyTag::solve_Linear x", "my-tag-solve-linear-x"),
        ("Whole Program", "whole-program"),
        ("a__b--c", "a-b-c"),
        ("HTTPServer", "httpserver"),
    ],
)
def test_normalise_tag(spark, tag, name):
    assert one(spark, text.normalise_tag(F.lit(tag))) == name


def test_text_expressions(spark):
    assert one(spark, text.safe_name(F.lit("a b/č.txt"))) == "a-b-txt"
    assert one(spark, text.safe_name(F.lit(None).cast("string"))) == ""
    assert one(spark, text.strip_prefix(F.lit("refs/heads/x"), "refs/heads/")) == "x"
    assert one(spark, text.strip_prefix(F.lit("x"), "refs/heads/")) == "x"
    assert one(spark, text.line_value(F.lit('\nNAME="Deb"\nVERSION="10"\n'), "VERSION=")) == "10"
    assert one(spark, text.line_value(F.lit('NAME="Deb"\nx'), "VERSION=")) == "NAME=Deb"
    assert [one(spark, text.parse_bool(F.lit(w))) for w in ("YES", "0", "maybe")] == [True, False, None]
    assert one(spark, text.series_title([], [])) == "*"


def test_template_casts(spark):
    mesh = F.lit("1_15786_el")
    part = text.template_part
    assert [one(spark, part(mesh, i, "i")) for i in (0, 1, 2, 3)] == [1, 15786, 0, 0]
    assert one(spark, part(F.lit("123"), None, "f")) == 123.0
    assert one(spark, part(F.lit("123"), None, "s")) == "123"
    assert one(spark, part(F.lit("True"), None, "b")) is True
    assert one(spark, part(F.lit(None).cast("string"), None, "s")) == ""
    with pytest.raises(ValueError):
        part(mesh, 0, "q")


def test_date_formats(spark):
    ts = F.lit(dt.datetime(2018, 4, 22, 12, 0, 35)).cast("timestamp_ntz")
    assert one(spark, dates.long_format(ts)) == "2018/04/22-12:00:35"
    assert one(spark, dates.short_format(ts)) == "2018/04/22"
    assert one(spark, dates.quarter_day(ts)) == "2018-04-22-q3(12-17)h"
    assert one(spark, dates.parse_stamp(F.lit("04/22/18 12:00:35"))) == 1524398435
    assert one(spark, dates.parse_stamp(F.lit("22.4.2018"))) is None


@pytest.mark.parametrize(
    ("seconds", "label"),
    [(0, "0 minute"), (60, "1 minute"), (150, "2 minutes"), (3600, "1 hour"), (7300, "2 hours"), (86400, "1 day"), (300000, "3 days")],
)
def test_human_interval(spark, seconds, label):
    start = F.expr("timestamp_ntz '2020-01-01 00:00:00'")
    end = F.timestamp_add("SECOND", F.lit(seconds), start)
    assert one(spark, dates.human_interval(start, end)) == label


def test_rounding(spark):
    got = [one(spark, numbers.round_even(F.lit(v), 2)) for v in (1 / 3, 2 / 3, 1.0, 0.125, 0.375, float("nan"))]
    assert got == [0.33, 0.67, 1.0, 0.12, 0.38, None]
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.logarithm(F.lit(0.0))) == float("-inf")
    assert one(spark, numbers.logarithm(F.lit(8.0), 2)) == 3.0
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (None, 1.0)], "a double, b double")
    assert df.where(numbers.no_zero_cell(F.col("a"), F.col("b"))).count() == 2


NESTED = "a struct<b:struct<c:int>, `x-y`:string>, l array<struct<n:string>>, v int"


def test_flatten_and_unwind(spark):
    df = spark.createDataFrame([(((1,), "q"), [("m",), ("n",)], 5), (((2,), "r"), [], 6), (((3,), "s"), None, 7)], NESTED)
    flat = reshape.flatten(df)
    assert flat.columns == ["a.b.c", "a.x-y", "l", "v"]
    assert reshape.flatten(df, "-").columns[0] == "a-b-c"
    rows = reshape.flatten(reshape.unwind(df, "l", "item"))
    assert [(r["a.b.c"], r["item.n"]) for r in rows.orderBy("`item.n`").collect()] == [(1, "m"), (1, "n")]


def test_nested_value(spark):
    df = spark.createDataFrame([((None,),), ((4,),)], "a struct<b:int>")
    assert [r[0] for r in df.select(reshape.nested_value("a.b", 9)).collect()] == [9, 4]


def test_cast_by_pattern_in_lists(spark):
    df = spark.createDataFrame(
        [([("f", "1.5", None), ("g", "bad", [("2",)])], "7")],
        "frames array<struct<name:string, wall_avg:string, inner:array<struct<size:string>>>>, num_iter string",
    )
    got = reshape.cast_by_pattern(df, {"wall_.+": "double", "num_iter": "int", "size": "int"}).first()
    assert got["frames"][0]["wall_avg"] == 1.5 and got["frames"][1]["wall_avg"] is None
    assert got["frames"][1]["inner"][0]["size"] == 2 and got["num_iter"] == 7


def test_merge_reports(spark):
    schema = "k int, result struct<a:int,b:int>, timers array<string>, index string"
    base = spark.createDataFrame([(1, (1, 2), ["x"], "old"), (2, (3, 4), None, "keep")], schema)
    update = spark.createDataFrame([(1, (9, None), ["y", "z"], "new")], schema)
    rows = {r["k"]: r for r in reshape.merge_reports(base, update, "k").collect()}
    assert rows[1]["result"].asDict() == {"a": 9, "b": 2}
    assert rows[1]["timers"] == ["x", "y", "z"] and rows[1]["index"] == "new"
    assert rows[2]["timers"] is None and rows[2]["index"] == "keep" and rows[2]["result"]["a"] == 3


def test_merge_into_missing_list(spark):
    base = spark.createDataFrame([(1, None)], "k int, timers array<string>")
    update = spark.createDataFrame([(1, ["y"])], "k int, timers array<string>")
    assert reshape.merge_reports(base, update, "k").first()["timers"] == ["y"]


def test_head_and_tail_of_empty_list(spark):
    df = spark.createDataFrame([([("1",), ("2",)],), ([],), (None,)], "libs array<struct<version:string>>")
    rows = reshape.head_and_tail(df, "libs", "version", "v").collect()
    assert [(r["v"], r["libs"]) for r in rows] == [("1", [("2",)]), (None, []), (None, None)]


def test_timers_to_columns_and_missing_timers(spark):
    schema = "id int, timers array<struct<name:string,duration:double>>"
    df = spark.createDataFrame([(1, [("a", 1.0), ("b", 2.0)]), (2, [("b", 3.0)]), (3, None)], schema)
    got = [tuple(r) for r in reshape.timers_to_columns(df, "id", ["a", "b"]).orderBy("id").collect()]
    assert got == [(1, 1.0, 2.0), (2, None, 3.0), (3, None, None)]


def test_attach_constants(spark):
    df = spark.createDataFrame([((1,),)], "problem struct<cpu:int>")
    row = reshape.attach_constants(df, "problem", {"stage": "test", "cpu": 4}).first()
    assert row["problem"].asDict() == {"cpu": 4, "stage": "test"}


def document(children):
    node = {"file-path": "a.cc", "function": "f", "file-line": "3", "cumul-time-sum": "8", "cumul-time-min": "1",
            "cumul-time-max": "2", "call-count-sum": "4", "memory-alloc-called-sum": "1", "memory-dealloc-called-sum": "1",
            "memory-alloc-sum": "100", "memory-dealloc-sum": "50"}

    def build(spec):
        tag, inner = spec
        return {**node, "tag": tag, **({"children": [build(c) for c in inner]} if inner else {})}

    return json.dumps({"program-version": "2.0", "task-size": "5", "run-process-count": "2", "children": [build(children)]})


def test_tree_preorder(spark):
    spec = ("Whole Program", [("A [[[", [("A1", []), ("A2", [("Deep", [])])]), ("B", [])])
    rows = [("d", document(spec)), ("empty", "{}"), ("bad", "{x"), ("null", None), ("leaf", document(("Only", [])))]
    df = spark.createDataFrame(rows, "k string, json string")
    assert tree.tree_levels(df, "json") == 4
    walked = tree.tree_rows(df, "k", "json").orderBy("k", "pos").collect()
    assert [r["path"] for r in walked if r["k"] == "d"] == [
        "/whole-program",
        "/whole-program/a-[[[",
        "/whole-program/a-[[[/a1",
        "/whole-program/a-[[[/a2",
        "/whole-program/a-[[[/a2/deep",
        "/whole-program/b",
    ]
    assert [r["path"] for r in walked if r["k"] == "leaf"] == ["/only"]
    assert {r["k"] for r in walked} == {"d", "leaf"}


@pytest.mark.parametrize("tag", ["MyTag::solve_Linear x", "aB__c--D", "ÄbC::", "", "A B [x]"])
def test_tag_in_python_tasks(spark, tag):
    assert one(spark, text.normalise_tag(F.lit(tag))) == text.normalised_tag(tag)


@pytest.mark.parametrize("number", [65, 90, 91, 255, 256, 321, 20_000, 55_064])
def test_code_points(spark, number):
    assert one(spark, text.code_point(F.lit(number))) == chr(number)


def test_deep_and_wide_trees(spark):
    deep = ("n0", [])
    for i in range(1, 120):
        deep = (f"n{i}", [deep])
    wide = ("root", [(f"w{i}", [("leaf", [])]) for i in range(300)])
    df = spark.createDataFrame([("deep", document(deep)), ("wide", document(wide))], "k string, json string")
    rows = tree.tree_rows(df, "k", "json").drop("node").orderBy("k", "pos").collect()
    deep_rows, wide_rows = ([r for r in rows if r["k"] == k] for k in ("deep", "wide"))
    assert [len(r["pos"]) for r in deep_rows] == list(range(1, 121)) and deep_rows[-1]["path"].endswith("/n1/n0")
    assert [r["path"] for r in wide_rows[1:5]] == ["/root/w0", "/root/w0/leaf", "/root/w1", "/root/w1/leaf"] and len(wide_rows) == 601


def test_profiler_reports(spark):
    texts = [("p", document(("Root", [("A b", [("C", [])]), ("D", [])]))), ("none", "{}"), ("bad", "{x"), ("null", None), ("list", "[1]")]
    df = spark.createDataFrame(texts, "source_path string, content string").withColumn("source_path", F.concat(F.lit("/r/"), "source_path", F.lit("/x.json")))
    got = {r["source_path"]: r for r in reports.collect(df, "profiler-report").collect()}
    assert set(got) == {"/r/p/x.json", "/r/none/x.json"}
    p, none = got["/r/p/x.json"], got["/r/none/x.json"]
    assert (p["git"]["version"], p["problem"]["task-size"], p["problem"]["cpus"]) == ("2.0", 5, 2.0)
    assert (p["result"]["name"], p["result"]["duration"], p["result"]["mem-alloc"], p["result"]["dur-ratio"]) == ("root", 4.0, 50.0, 0.5)
    assert [(t["path"], t["duration"]) for t in p["timers"]] == [("/root", 8.0), ("/root/a-b", 8.0), ("/root/a-b/c", 8.0), ("/root/d", 8.0)]
    assert none["result"] is None and not none["timers"]
    side = spark.createDataFrame([("/r/p", 3, 9.5, "t1", None)], "run_dir string, returncode int, duration double, `test-name` string, `case-name` string")
    joined = {r["source_path"]: r for r in reports.with_sidecar(reports.collect(df, "profiler-report"), side, own_first=True).collect()}
    assert joined["/r/p/x.json"]["result"]["returncode"] == 3 and joined["/r/p/x.json"]["problem"]["test-name"] == "t1"
    # The root's own duration stands before that of the status file.
    assert joined["/r/p/x.json"]["result"]["duration"] == 4.0 and joined["/r/none/x.json"]["result"] is not None


def test_node_metrics(spark):
    df = spark.createDataFrame([("d", document(("Root", [])))], "k string, json string")
    row = tree.tree_rows(df, "k", "json").select(*tree.node_metrics("node", F.lit(2))).first()
    assert (row["duration"], row["executed"], row["mem-alloc"], row["dur-ratio"]) == (4.0, 2.0, 50.0, 0.5)
    assert (row["file-line"], row["function"]) == (3, "f")


@pytest.mark.parametrize(("name", "want"), [("case.4.1_200_el", ("case", 4, 200)), ("case.2.50", ("case", 2, 50)), ("case.3", ("case", 3, 0)), ("a.b.c.d", ("a.b.c.d", 0, 0)), ("x", ("x", 0, 0))])
def test_run_from_directory(spark, name, want):
    assert tuple(one(spark, tree.run_from_directory(F.lit(name)))) == want


def test_wildcards_and_rules(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("b", 3, "y")], "`t-n` string, cpu int, z string")
    assert df.where(filters.equal_to({"t-n": "b", "cpu": "*", "z": ""})).count() == 2
    assert df.where(filters.equal_to({})).count() == 3
    assert df.where(filters.match_rules(_t_n="b", cpu=[3, 4], z=None)).count() == 1


def test_level_filters():
    test = {"name": "mesh", "filters": {"rc": 0}}
    case = {"name": "read", "filters": {"rc": 1, "cpu": 2}}
    assert filters.level_filters([test, case]) == {"rc": 0, "cpu": 2, "problem.test": "mesh", "problem.case": "read"}
    assert filters.level_filters([test, {"name": "weak", "level": None, "filters": {"w": 1}}]) == {"rc": 0, "w": 1, "problem.test": "mesh"}
    assert filters.level_filters([{"name": "m", "level": "other"}]) == {"other": "m"}


def test_group_filters_and_key_filters():
    assert filters.group_filters({"date": "d", "cpu": "*", "x.y": 3}, {"date": "git.datetime", "cpu": "problem.cpu"}) == {"git.datetime": "d", "x.y": 3}
    d = {"a": 1, "b": "*"}
    assert filters.with_values(d, forbidden=("*",)) == {"a": 1}
    assert filters.with_names(d, required=("b",)) == {"b": "*"}


@pytest.mark.parametrize(("ref", "match"), [("refs/heads/master", True), ("refs/heads/master2", True), ("refs/heads/release-1", True), ("refs/heads/my-release", False), ("refs/tags/v1", False)])
def test_branch_matches(spark, ref, match):
    assert one(spark, filters.branch_matches(F.lit(ref), ["master", "release*"])) is match
    assert one(spark, filters.branch_matches(F.lit(ref), None)) is True


def test_range_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(5)], "id int, t timestamp_ntz")
    df.write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).where(filters.between_epochs(F.col("t"), 1704153600, "1704240000"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThanOrEqual(t" in plan
