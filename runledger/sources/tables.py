"""Run history derived from the shared analytics tables: every event is the report of one run.

All views are projections of one table, so they scale with it and never need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.plans.options import FieldMapping


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports with three timers each, from ``events``."""
    day = "cast(date_trunc('DAY', ts) as timestamp_ntz)"
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(
        "event_id as _id",
        "ts as started",
        "named_struct('hostname', concat('node', user_id % 5, '.grid.example')) as system",
        """named_struct(
            'test-name', event_type,
            'case-name', concat('case-', user_id % 2),
            'cpu', cast(1 + user_id % 4 as int),
            'mesh', concat(1 + user_id % 4, '_', k, '_el'),
            'task-size', cast(k as bigint) * 100,
            'weak', k % 2) as problem""",
        "named_struct('duration', value, 'returncode', cast(event_type = 'error' as int)) as result",
        f"""named_struct(
            'branch', element_at(array('master', 'release-1.0', 'feature/io'), cast(user_id % 3 + 1 as int)),
            'commit', md5(cast(cast(ts as date) as string)),
            'datetime', {day},
            'tag', concat('reps-', k)) as git""",
        """array(
            named_struct('name', 'whole-program', 'path', '/whole-program', 'duration', value),
            named_struct('name', concat('assembly-', user_id % 3),
                         'path', concat('/whole-program/assembly-', user_id % 3), 'duration', value * 0.25),
            named_struct('name', 'solve', 'path', cast(null as string), 'duration', k / 100.0D)) as timers""",
        """array(
            named_struct('name', 'core', 'version', concat('1.', user_id % 7)),
            named_struct('name', 'io', 'version', concat('0.', k))) as libs""",
    )


# Where the canonical fields of these reports come from.
MAPPING = FieldMapping(
    fields={
        "result.duration": "result.duration",
        "result.returncode": "result.returncode",
        "git.datetime": "git.datetime",
        "git.commit": "git.commit",
        "git.branch": "git.branch",
        "problem.test": "problem.test-name",
        "problem.case": "problem.case-name",
        "problem.subcase": None,
        "problem.cpu": "problem.cpu",
        "problem.size": "= cast(split(problem.mesh, '_')[1] as int)",
        "problem.per.cpu": "= cast(problem.`task-size` / problem.cpu as int)",
        "problem.scale": "= if(problem.weak = 1, 'weak', 'strong')",
    },
    extra=("problem.task-size", "problem.weak", "problem.mesh"),
    group_names={"problem.scale": "scale", "git.branch": "branch"},
)
# The same without a size, for series that have many runs each.
COARSE_MAPPING = FieldMapping(
    fields={
        "result.duration": "result.duration",
        "git.datetime": "git.datetime",
        "git.commit": "git.commit",
        "git.branch": "git.branch",
        "problem.test": "problem.test-name",
        "problem.cpu": "problem.cpu",
        "problem.scale": "= if(problem.weak = 1, 'weak', 'strong')",
    },
    group_names={"problem.scale": "scale"},
)


def walltimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements per tag on exclusive and shared nodes, from ``lineitem``.

    The run time of a tag grows with its number; the price is the noise of a run.
    """
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as run_key",
        "l_linenumber as run_line",
        "l_partkey as run_part",
        "l_suppkey as run_node",
        "concat('reps-', lpad(cast(70 + 5 * l_linenumber as string), 3, '0')) as tag",
        "l_linestatus = 'F' as excl",
        "(70 + 5 * l_linenumber) * (100 + floor(l_extendedprice / 100) / 100) as walltime",
        "l_quantity / 10 as walltime_mem_l1",
        "l_discount * 10 as walltime_mem_l2",
        "l_tax * 10 as walltime_mem_l3",
        "l_shipdate as started",
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order: branch, author and date."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as position",
        "md5(cast(o_orderkey as string)) as commit",
        "o_orderstatus as branch",
        "concat('author-', o_custkey) as author",
        "o_orderdate as date",
    )
