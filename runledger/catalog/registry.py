"""Registry of the checked queries: a DataFrame builder and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; ``sql`` is left out only where SQL cannot say the same."""

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# The derived views of the data in SQL, as common table expressions.
REPORTS = """
reports AS (
  SELECT event_id AS id, ts AS started, value AS duration,
         (event_type = 'error')::INT AS returncode,
         event_type AS test, 'case-' || (user_id % 2) AS kase, (1 + user_id % 4)::INT AS cpu,
         (props->>'k')::INT AS size, user_id AS u, ((props->>'k')::INT % 2) AS weak,
         CASE WHEN (props->>'k')::INT % 2 = 1 THEN 'weak' ELSE 'strong' END AS scale,
         ['master', 'release-1.0', 'feature/io'][(user_id % 3 + 1)::INT] AS branch,
         md5(strftime(ts, '%Y-%m-%d')) AS commit, date_trunc('day', ts)::TIMESTAMP AS dt,
         'node' || (user_id % 5) || '.grid.example' AS hostname
  FROM events)
"""
TIMERS = f"""{REPORTS},
timers AS (
  SELECT *, 'whole-program' AS name, '/whole-program' AS path, duration AS seconds FROM reports
  UNION ALL
  SELECT *, 'assembly-' || (u % 3), '/whole-program/assembly-' || (u % 3), duration * 0.25 FROM reports
  UNION ALL
  SELECT *, 'solve', NULL, size / 100.0::DOUBLE FROM reports)
"""
WALLTIMES = """
walltimes AS (
  SELECT l_orderkey AS run_key, l_linenumber AS run_line, l_partkey AS run_part, l_suppkey AS run_node,
         'reps-' || lpad((70 + 5 * l_linenumber)::VARCHAR, 3, '0') AS tag, l_linestatus = 'F' AS excl,
         (70 + 5 * l_linenumber) * (100 + floor(l_extendedprice / 100) / 100) AS walltime, l_quantity / 10 AS walltime_mem_l1,
         l_discount * 10 AS walltime_mem_l2, l_tax * 10 AS walltime_mem_l3, l_shipdate AS started
  FROM lineitem)
"""
COMMITS = """
commits AS (
  SELECT o_orderkey AS position, md5(o_orderkey::VARCHAR) AS commit, o_orderstatus AS branch,
         'author-' || o_custkey AS author, o_orderdate AS date
  FROM orders)
"""


def t_critical_sql(stats: str) -> str:
    """Common table expressions giving ``tcrit(n, t)`` for every group size ``n`` of a table.

    Bisection on the finite trigonometric sums of the t distribution; above 1001 values the expansion
    about the normal quantile.
    """
    theta, even, odd = (
        "atan(mid / sqrt(n - 1))",
        "exp(lgamma(2 * j + 1) - j * ln(4) - 2 * lgamma(j + 1)) * pow(cos(th), 2 * j)",
        "exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos(th), 2 * j + 1)",
    )
    z = 1.959963984540054
    g = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = " + ".join(f"{c!r} / pow(n - 1, {i + 1})" for i, c in enumerate(g))
    return f"""
bisect AS (
  SELECT DISTINCT n, 0.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS it FROM {stats} WHERE n BETWEEN 2 AND 1001
  UNION ALL
  SELECT n, CASE WHEN inside < 0.95 THEN mid ELSE lo END, CASE WHEN inside < 0.95 THEN hi ELSE mid END, it + 1
  FROM (SELECT *, CASE WHEN n % 2 = 1
      THEN sin(th) * list_sum(list_transform(range(0, (n - 1) // 2), lambda j: {even}))
      ELSE 2 / pi() * (th + CASE WHEN n > 2
          THEN sin(th) * list_sum(list_transform(range(0, (n - 2) // 2), lambda j: {odd})) ELSE 0 END) END AS inside
    FROM (SELECT *, {theta} AS th FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE it < 60)))),
tcrit AS (
  SELECT n, (lo + hi) / 2 AS t FROM bisect WHERE it = 60
  UNION ALL
  SELECT DISTINCT n, {z!r} + {series} FROM {stats} WHERE n > 1001)
"""
