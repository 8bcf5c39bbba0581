"""Queries that select reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from runledger.catalog.registry import COMMITS, REPORTS, TIMERS, query
from runledger.operators import filters, history
from runledger.operators.reshape import match_unwind_select
from runledger.sources import tables

def short():
    return [
        F.col("problem.test-name").alias("test"),
        F.col("problem.cpu").alias("cpu"),
        F.col("git.branch").alias("branch"),
        F.col("result.duration").alias("duration"),
    ]


def flat(spark, sf_dir):
    return tables.MAPPING.apply(tables.reports(spark, sf_dir), keep=("_id",))


@query(
    "filter_wildcard",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, branch, duration FROM reports WHERE returncode = 0 AND cpu = 2""",
)
def filter_wildcard(spark, sf_dir):
    asked = {"problem.test-name": "*", "problem.cpu": 2, "git.branch": "", "problem.mesh": None, "result.returncode": 0}
    columns = {name: F.col(".".join(f"`{p}`" for p in name.split("."))) for name in asked}
    return tables.reports(spark, sf_dir).where(filters.equal_to(asked, columns)).select("_id", *short())


@query(
    "filter_range",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, branch, duration FROM reports
       WHERE dt BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",
)
def filter_range(spark, sf_dir):
    inside = filters.between_epochs(F.col("git.datetime"), "1704412800", "1705017600")
    return tables.reports(spark, sf_dir).where(inside).select("_id", *short())


@query(
    "filter_rules",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, branch, duration FROM reports WHERE cpu IN (1, 3) AND test = 'click'""",
)
def filter_rules(spark, sf_dir):
    rows = tables.reports(spark, sf_dir).select("_id", *short()).withColumnRenamed("test", "test-name")
    kept = rows.where(filters.match_rules(cpu=[1, 3], _test_name="click", branch=None))
    return kept.withColumnRenamed("test-name", "test")


@query(
    "nested_test_filters",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, branch, duration FROM reports
       WHERE returncode = 0 AND test = 'view' AND weak = 1""",
)
def nested_test_filters(spark, sf_dir):
    path = [
        {"name": "view", "filters": {"result.returncode": 0}},
        {"name": "weak scaling", "level": None, "filters": {"problem.weak": 1, "result.returncode": 1}},
    ]
    condition = filters.equal_to(filters.level_filters(path))
    rows = flat(spark, sf_dir).where(condition)
    return rows.select(
        "_id",
        F.col("`problem.test`").alias("test"),
        F.col("`problem.cpu`").alias("cpu"),
        F.col("`git.branch`").alias("branch"),
        F.col("`result.duration`").alias("duration"),
    )


@query(
    "group_alias_filters",
    f"""WITH {REPORTS} SELECT id AS _id, scale, branch FROM reports WHERE scale = 'weak' AND branch = 'master' AND returncode = 0""",
)
def group_alias_filters(spark, sf_dir):
    asked = filters.group_filters(
        {"scale": "weak", "branch": "master", "size": "*", "result.returncode": 0},
        {"scale": "problem.scale", "branch": "git.branch", "size": "problem.size"},
    )
    rows = flat(spark, sf_dir).where(filters.equal_to(asked))
    return rows.select("_id", F.col("`problem.scale`").alias("scale"), F.col("`git.branch`").alias("branch"))


@query(
    "branch_match",
    f"""WITH {REPORTS} SELECT branch, count(*) AS items FROM reports WHERE branch LIKE 'master%' OR branch LIKE 'release%' GROUP BY 1""",
)
def branch_match(spark, sf_dir):
    ref = F.concat(F.lit("refs/heads/"), F.col("git.branch"))
    rows = tables.reports(spark, sf_dir).where(filters.branch_matches(ref, ["master", "release*"]))
    return rows.groupBy(F.col("git.branch").alias("branch")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "match_unwind_match",
    f"""WITH {TIMERS} SELECT id AS _id, test, cpu, name, seconds AS duration FROM timers
       WHERE commit = md5('2024-01-10') AND test <> 'error' AND name = 'whole-program'""",
)
def match_unwind_match(spark, sf_dir):
    before = (F.col("git.commit") == F.md5(F.lit("2024-01-10"))) & (F.col("problem.test-name") != "error")
    columns = [F.col("_id"), *short()[:2], F.col("timers.name"), F.col("timers.duration")]
    return match_unwind_select(
        tables.reports(spark, sf_dir), before, "timers", columns, F.col("timers.name") == "whole-program"
    )


@query(
    "drilldown_semi",
    f"""WITH {TIMERS}, chosen AS (SELECT DISTINCT id FROM reports WHERE duration > 50)
       SELECT id AS _id, name, round(seconds, 8) AS duration FROM timers WHERE id IN (SELECT id FROM chosen)""",
)
def drilldown_semi(spark, sf_dir):
    reports = tables.reports(spark, sf_dir)
    selected = reports.where("result.duration > 50").select(F.explode(F.array("_id", "_id")).alias("_id"))
    rows = filters.members(reports, "_id", selected).select("_id", F.explode("timers").alias("t"))
    return rows.select("_id", "t.name", F.round("t.duration", 8).alias("duration"))


@query(
    "active_branches",
    f"""WITH {COMMITS} SELECT branch, max(date) AS date FROM commits GROUP BY branch
       HAVING max(date) >= TIMESTAMP '2001-02-01 00:00:00'""",
)
def active_branches(spark, sf_dir):
    return history.active_branches(tables.commits(spark, sf_dir), "branch", "date", dt.datetime(2001, 8, 1))


@query(
    "zero_cells",
    """SELECT l_orderkey AS run_key, l_discount AS a, l_tax AS b FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0""",
)
def zero_cells(spark, sf_dir):
    from runledger.functions.numbers import no_zero_cell

    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_key"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b")
    )
    return rows.where(no_zero_cell(F.col("a"), F.col("b")))
