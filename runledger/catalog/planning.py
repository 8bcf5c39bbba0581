"""Experiment designs and what is left to run."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.aggregation import flat, rounded
from runledger.catalog.registry import COMMITS, REPORTS, query
from runledger.operators import design
from runledger.sources import tables


def part_sections(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("section"),
        F.col("p_brand").alias("benchmark"),
        F.col("p_size").alias("size"),
        F.col("p_type").alias("mesh"),
    )


@query(
    "design_matrix",
    """SELECT p_partkey AS section, c AS cpu, s AS scale, z AS level, ((ci - 1) * 2 * zn + (si - 1) * zn + (zi - 1) + 1)::BIGINT AS current, (3 * 2 * zn)::BIGINT AS total
    FROM (SELECT p_partkey, p_size % 3 + 1 AS zn FROM part),
      (VALUES (1, 1), (2, 2), (3, 4)) AS a(ci, c), (VALUES (1, 'weak'), (2, 'strong')) AS b(si, s),
      LATERAL (SELECT unnest(range(1, zn + 1)) AS zi) , LATERAL (SELECT zi AS z)""",
)
def design_matrix(spark, sf_dir):
    variables = {
        "cpu": F.array(F.lit(1), F.lit(2), F.lit(4)),
        "scale": F.array(F.lit("weak"), F.lit("strong")),
        "level": F.sequence(F.lit(1).cast("bigint"), (F.col("size") % 3 + 1).cast("bigint")),
    }
    rows = design.matrix(part_sections(spark, sf_dir), variables)
    return rows.select("section", "cpu", "scale", "level", "current", "total")


@query(
    "design_zip",
    """SELECT p_partkey AS section, p_brand AS benchmark, p_type || '-' || i AS mesh, i::INT AS cpu, i::BIGINT AS current, 4::BIGINT AS total FROM part, (SELECT unnest([1, 2, 3, 4]) AS i)""",
)
def design_zip(spark, sf_dir):
    numbers = F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    variables = {"mesh": F.transform(numbers, lambda i: F.concat_ws("-", "mesh", i)), "cpu": numbers}
    rows = design.zipped(part_sections(spark, sf_dir), variables, {"benchmark": F.col("benchmark")})
    return rows.select("section", "benchmark", "mesh", "cpu", "current", "total")


@query(
    "design_union",
    """SELECT p_partkey AS section, c AS cpu, NULL AS mesh FROM part, (SELECT unnest([1, 2]) AS c)
    UNION ALL SELECT p_partkey, NULL, p_type FROM part""",
)
def design_union(spark, sf_dir):
    base = part_sections(spark, sf_dir)
    one = design.matrix(base, {"cpu": F.array(F.lit(1), F.lit(2))}).select("section", "cpu")
    two = design.zipped(base, {"kind": F.array("mesh")}).select("section", F.col("kind").alias("mesh"))
    return design.sections(one, two)


def plan_of(spark, sf_dir):
    """Planned configurations: every commit and test of the history on one to five CPUs."""
    keys = flat(spark, sf_dir).select("commit", "test").distinct()
    return design.matrix(keys, {"cpu": F.sequence(F.lit(1), F.lit(5))}).select("commit", "test", "cpu")


REMAINING_SQL = f"""{REPORTS}, plan AS (SELECT commit, test, cpu FROM (SELECT DISTINCT commit, test FROM reports), (SELECT unnest([1, 2, 3, 4, 5]) AS cpu)),
    found AS (SELECT commit, test, cpu, count(*) AS found FROM reports GROUP BY ALL),
    remaining AS (SELECT commit, test, cpu, coalesce(found, 0) AS found, greatest(18 - coalesce(found, 0), 0) AS remaining FROM plan LEFT JOIN found USING (commit, test, cpu))"""
SPEC = {"exactly": 10, "no-less-than": 18}


def remaining(spark, sf_dir):
    found = design.index_counts(flat(spark, sf_dir), ["commit", "test", "cpu"])
    return design.remaining_runs(plan_of(spark, sf_dir), found, ["commit", "test", "cpu"], SPEC)


@query("remaining_runs", f"""WITH {REMAINING_SQL} SELECT * FROM remaining""")
def remaining_runs(spark, sf_dir):
    return remaining(spark, sf_dir)


@query(
    "run_tasks",
    f"""WITH {REMAINING_SQL} SELECT commit, test, cpu, r::BIGINT AS repetition FROM remaining, LATERAL (SELECT unnest(range(1, remaining + 1)) AS r)""",
)
def run_tasks(spark, sf_dir):
    return design.run_tasks(remaining(spark, sf_dir)).select("commit", "test", "cpu", "repetition")


@query(
    "commit_backlog",
    f"""WITH {REPORTS}, {COMMITS}, configs AS (SELECT DISTINCT test, cpu FROM reports),
    every AS (SELECT c.commit, f.test, f.cpu FROM (SELECT DISTINCT commit FROM reports UNION SELECT commit FROM commits) c, configs f),
    found AS (SELECT commit, test, cpu, count(*) AS found FROM reports GROUP BY ALL)
    SELECT commit, count(*) FILTER (coalesce(found, 0) < 18) AS short, sum(greatest(18 - coalesce(found, 0), 0))::BIGINT AS missing_runs,
      bool_or(coalesce(found, 0) < 18) AS need_run FROM every LEFT JOIN found USING (commit, test, cpu) GROUP BY 1""",
)
def commit_backlog(spark, sf_dir):
    reports = flat(spark, sf_dir)
    known = reports.select("commit").union(tables.commits(spark, sf_dir).select("commit"))
    found = design.index_counts(reports, ["commit", "test", "cpu"])
    plan = reports.select("test", "cpu").distinct()
    return design.commit_backlog(known, plan, found, "commit", ["test", "cpu"], SPEC)


@query(
    "effort_estimate",
    f"""WITH {REPORTS}, t AS (SELECT test, count(*) AS reps, sum(duration) AS d FROM reports GROUP BY 1)
    SELECT test, reps, round(d, 6) AS duration, greatest(2500 - reps, 0)::BIGINT AS remaining, round(d / reps * greatest(2500 - reps, 0), 6) AS seconds_left FROM t""",
)
def effort_estimate(spark, sf_dir):
    history = flat(spark, sf_dir).groupBy("test", "dt").agg(
        F.count(F.lit(1)).alias("reps"), F.sum("duration").alias("duration")
    )
    return rounded(design.effort_estimate(history, ["test"], "reps", "duration", 2500), digits=6)
