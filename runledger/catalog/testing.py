"""Statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.aggregation import rounded
from runledger.catalog.registry import REPORTS, WALLTIMES, query, t_critical_sql
from runledger.operators import aggregates, statistics
from runledger.sources import tables


def flat(spark, sf_dir):
    return tables.reports(spark, sf_dir).select(
        "_id",
        F.col("problem.test-name").alias("test"),
        F.col("problem.cpu").alias("cpu"),
        F.col("git.branch").alias("branch"),
        F.col("git.datetime").alias("dt"),
        F.col("result.duration").alias("duration"),
    )


@query(
    "anova_f",
    f"""WITH {REPORTS}, g AS (SELECT test, branch, count(*) AS n, avg(duration) AS m, var_pop(duration) AS v FROM reports GROUP BY ALL),
    grand AS (SELECT test, sum(n * m) / sum(n) AS gm, sum(n) AS total, count(*) AS k FROM g GROUP BY test),
    f AS (SELECT test, any_value(k) - 1 AS dfb, any_value(total) - any_value(k) AS dfw,
      (sum(n * (m - gm) ** 2) / (any_value(k) - 1)) / (sum(n * v) / (any_value(total) - any_value(k))) AS f FROM g JOIN grand USING (test) GROUP BY test)
    SELECT test, dfb::BIGINT AS df_between, dfw::BIGINT AS df_within, round(f, 6) AS f, round(pow(1 + 2 * f / dfw, -dfw / 2), 6) AS p_value FROM f""",
)
def anova_f(spark, sf_dir):
    return rounded(statistics.anova(flat(spark, sf_dir), ["test"], "branch", "duration"), digits=6)


@query(
    "normality_k2",
    f"""WITH {WALLTIMES},
    a AS (SELECT tag, excl, avg(walltime) AS m FROM walltimes GROUP BY ALL),
    c AS (SELECT tag, excl, count(*)::DOUBLE AS n, any_value(m) AS mean, stddev_samp(walltime) AS std, avg((walltime - m) ** 2) AS m2,
          avg((walltime - m) ** 3) AS m3, avg((walltime - m) ** 4) AS m4 FROM walltimes JOIN a USING (tag, excl) GROUP BY ALL),
    s AS (SELECT *, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 AS b2 FROM c),
    sk AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be,
          (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM s),
    w AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM sk),
    z AS (SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt(y * y / (2 / (w2 - 1)) + 1)) / sqrt(0.5 * ln(w2)) AS z1,
          (1 - 2 / (9 * aa) - sign(1 + x * sqrt(2 / (aa - 4))) * cbrt((1 - 2 / aa) / abs(1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM w)
    SELECT tag, excl, n::BIGINT AS n, round(mean, 6) AS mean, round(std, 6) AS std, round(z1 * z1 + z2 * z2, 4) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z""",
)
def normality(spark, sf_dir):
    rows = statistics.normality(tables.walltimes(spark, sf_dir), ["tag", "excl"], "walltime")
    return rounded(rows.withColumn("k2", F.round("k2", 4)), digits=6)


@query(
    "mean_ci",
    f"""WITH RECURSIVE {REPORTS}, stats AS (SELECT test, cpu, dt, count(duration) AS n, avg(duration) AS mean, stddev_samp(duration) AS std FROM reports GROUP BY ALL),
    {t_critical_sql("stats")}
    SELECT test, cpu, dt, round(mean, 6) AS mean, round(mean - std / sqrt(n) * t, 6) AS low, round(mean + std / sqrt(n) * t, 6) AS high
    FROM stats LEFT JOIN tcrit USING (n)""",
)
def mean_ci(spark, sf_dir):
    stats = aggregates.point_stats(flat(spark, sf_dir), ["test", "cpu", "dt"], "duration", ("mean", "ci"))
    mean, ci = F.col("mean"), F.col("ci")
    return rounded(stats.select("test", "cpu", "dt", "mean", (mean - ci).alias("low"), (mean + ci).alias("high")), digits=6)


@query(
    "welch_baseline",
    f"""WITH {REPORTS}, g AS (SELECT test, cpu, count(*) AS n, avg(duration) AS m, var_samp(duration) AS v FROM reports GROUP BY ALL),
    p AS (SELECT b.test, a.cpu AS setting_a, b.cpu AS setting_b, a.m AS mean_a, b.m AS mean_b, a.v / a.n AS ea, b.v / b.n AS eb, a.n AS na, b.n AS nb
      FROM g b JOIN g a ON a.test = b.test AND a.cpu = (SELECT min(cpu) FROM g x WHERE x.test = b.test) AND a.cpu <> b.cpu)
    SELECT test, setting_a, setting_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round((mean_a - mean_b) / sqrt(ea + eb), 6) AS t,
      round((ea + eb) ** 2 / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 4) AS dof FROM p""",
)
def welch_baseline(spark, sf_dir):
    """Statistic and degrees of freedom; the p-value has no closed form in SQL and is unit-tested."""
    rows = statistics.welch_against_baseline(flat(spark, sf_dir), ["test"], "cpu", "duration").drop("p_value", "reject")
    return rounded(rows.withColumns({"t": F.round("t", 6), "dof": F.round("dof", 4)}))


def kruskal_sql(keys):
    return f"""WITH {REPORTS}, r AS (SELECT {keys}, branch, duration, rank() OVER w + (count(*) OVER (PARTITION BY {keys}, duration) - 1) / 2.0::DOUBLE AS r,
      count(*) OVER (PARTITION BY {keys}) AS n FROM reports WINDOW w AS (PARTITION BY {keys} ORDER BY duration)),
    s AS (SELECT {keys}, branch, any_value(n)::DOUBLE AS n, count(*) AS ni, sum(r) AS ri FROM r GROUP BY ALL),
    t AS (SELECT {keys}, sum(c ** 3 - c) AS tied FROM (SELECT {keys}, duration, count(*)::DOUBLE AS c FROM reports GROUP BY ALL) GROUP BY ALL)
    SELECT {keys}, count(*) - 1 AS dof, any_value(n)::BIGINT AS n,
      round((12 / (any_value(n) * (any_value(n) + 1)) * sum(ri * ri / ni) - 3 * (any_value(n) + 1)) / (1 - any_value(tied) / (any_value(n) ** 3 - any_value(n))), 6) AS h
    FROM s JOIN t USING ({keys}) GROUP BY ALL"""


KRUSKAL_SQL = kruskal_sql("test")


@query("kruskal", KRUSKAL_SQL)
def kruskal(spark, sf_dir):
    return rounded(statistics.kruskal(flat(spark, sf_dir), ["test"], "branch", "duration"), digits=6)


@query(
    "kruskal_decision",
    f"""WITH h AS ({kruskal_sql("test, cpu")}),
    p AS (SELECT *, exp(-h / 2) AS p_value FROM h),
    r AS (SELECT *, row_number() OVER (ORDER BY p_value, test, cpu) AS place, count(*) OVER () AS tests FROM p),
    f AS (SELECT min(place) AS failed FROM r WHERE p_value > 0.05 / (tests - place + 1))
    SELECT test, cpu, dof, n, h, round(p_value, 5) AS p_value, coalesce(place < failed, true) AS reject FROM r, f""",
)
def kruskal_decision(spark, sf_dir):
    """Branches within each test and CPU count: two degrees of freedom, whose tail is an exponential."""
    rows = rounded(statistics.kruskal_decision(flat(spark, sf_dir), ["test", "cpu"], "branch", "duration"), "p_value", digits=6)
    return rows.withColumn("p_value", F.round("p_value", 5))


@query("kruskal_spread", KRUSKAL_SQL)
def kruskal_spread(spark, sf_dir):
    """Kept under its earlier name: there is one plan for every size now."""
    return rounded(statistics.kruskal(flat(spark, sf_dir), ["test"], "branch", "duration"), digits=6)


# The study's sizes and repetitions, and the tag that is compared with itself as a control.
SIZES, REPS, SEED, DRAWS, CONTROL = [2, 3, 4, 5, 6, 8, 10, 20, 30, 40, 50, 60, 70, 80, 99], 200, 1234, 1000, "reps-100"


def power(spark, sf_dir, use_log=False):
    rows = tables.walltimes(spark, sf_dir)
    pairs = statistics.neighbours(rows, ["excl"], "tag").withColumn("experiment", F.concat_ws(" & ", "group_a", "group_b"))
    control = rows.where(F.col("tag") == CONTROL).select("excl", F.col("tag").alias("group_a"), F.col("tag").alias("group_b")).distinct()
    experiments = pairs.unionByName(control.withColumn("experiment", F.lit("same performance")))
    order = [F.col(c) for c in ("run_key", "run_line", "run_part", "run_node", "started", "walltime")]
    return statistics.anova_power(rows, experiments, ["excl"], "tag", "walltime", order, SIZES, REPS, SEED, use_log)


def _hash_sql(*parts):
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 15))::BIGINT"


def power_sql(use_log=False):
    """Common table expressions up to ``study``: the same permutations, moments and, by its finite series, p-values."""
    measured = "ln(walltime)" if use_log else "walltime"
    turns, before = "", "draws"
    for number in range(4):
        key = f"{SEED}, experiment, excl::VARCHAR, side, rep, {number}"
        low = f"(low + {_hash_sql(key, 'high')} % a) % a" if number % 2 == 0 else "low"
        high = "high" if number % 2 == 0 else f"(high + {_hash_sql(key, 'low')} % b) % b"
        turns += f"turn{number} AS (SELECT * EXCLUDE (low, high), {low} AS low, {high} AS high FROM {before}),\n"
        before = f"turn{number}"
    return f"""{WALLTIMES},
    measured AS (SELECT excl, tag, {measured}::DOUBLE AS x, row_number() OVER (PARTITION BY excl, tag
      ORDER BY run_key, run_line, run_part, run_node, started, walltime) AS row_no FROM walltimes),
    sizes AS (SELECT excl, tag, count(*) AS n, avg(x) AS centre FROM measured GROUP BY ALL),
    pairs AS (SELECT excl, tag AS ga, lead(tag) OVER (PARTITION BY excl ORDER BY tag) AS gb FROM sizes),
    experiments AS (SELECT excl, ga, gb, ga || ' & ' || gb AS experiment FROM pairs WHERE gb IS NOT NULL
      UNION ALL SELECT excl, tag, tag, 'same performance' FROM sizes WHERE tag = '{CONTROL}'),
    sized AS (SELECT e.*, a.centre, a.n AS na, b.n AS nb, list_max(list_filter({SIZES}, lambda s: s <= a.n AND s <= b.n)) AS most
      FROM experiments e JOIN sizes a ON a.excl = e.excl AND a.tag = ga JOIN sizes b ON b.excl = e.excl AND b.tag = gb),
    sides AS (SELECT experiment, excl, centre, most, 'a' AS side, ga AS tag, na AS n FROM sized WHERE most IS NOT NULL
      UNION ALL SELECT experiment, excl, centre, most, 'b', gb, nb FROM sized WHERE most IS NOT NULL),
    roots AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b, unnest(range(1, {REPS + 1})) AS rep FROM sides),
    indexes AS (SELECT *, unnest(range(0, most + least(a * b - n, most))) AS index FROM roots),
    draws AS (SELECT *, index % a AS low, index // a AS high FROM indexes),
    {turns}
    placed AS (SELECT *, high * a + low + 1 AS row_no, row_number() OVER (PARTITION BY experiment, excl, rep, side ORDER BY index) AS place
      FROM turn3 WHERE high * a + low < n QUALIFY place <= most),
    steps AS (SELECT experiment, excl, rep, list_min(list_filter({SIZES}, lambda s: s >= place))::INT AS sample_size, any_value(centre) AS centre,
        coalesce(sum(x - centre) FILTER (side = 'a'), 0) AS a, coalesce(sum(x - centre) FILTER (side = 'b'), 0) AS b,
        coalesce(sum((x - centre) * (x - centre)) FILTER (side = 'a'), 0) AS aa, coalesce(sum((x - centre) * (x - centre)) FILTER (side = 'b'), 0) AS bb
      FROM placed JOIN measured USING (excl, tag, row_no) GROUP BY ALL),
    totals AS (SELECT experiment, excl, rep, sample_size, centre, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(aa) OVER w AS aa, sum(bb) OVER w AS bb
      FROM steps WINDOW w AS (PARTITION BY experiment, excl, rep ORDER BY sample_size)),
    tested AS (SELECT *, (2 * sample_size - 2)::BIGINT AS df_within, atan(sqrt(((a - b) * (a - b) / (2 * sample_size))
      / nullif(greatest(aa - a * a / sample_size + bb - b * b / sample_size, 0), 0))) AS th FROM totals),
    study AS (SELECT experiment, excl, sample_size, rep, df_within, centre + a / sample_size AS mean_a, centre + b / sample_size AS mean_b,
      1 - sin(th) * list_sum(list_transform(range(0, df_within // 2), lambda j:
        exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(cos(th), 2 * j))) AS p_value FROM tested)
"""


def power_rows(rows):
    """Means of values with two decimals may lie half way between two rounded ones: all are moved by a little first."""
    means = {c: F.round(F.col(c) + 1e-9, 4) for c in ("mean_a", "mean_b")}
    return rows.withColumns({**means, "p_value": F.round("p_value", 5)}).drop("f", "df_between")


POWER_COLUMNS = "experiment, excl, sample_size, rep, df_within, round(mean_a + 1e-9, 4) AS mean_a, round(mean_b + 1e-9, 4) AS mean_b, round(p_value, 5) AS p_value"


@query("anova_power", f"WITH {power_sql()} SELECT {POWER_COLUMNS} FROM study")
def anova_power(spark, sf_dir):
    return power_rows(power(spark, sf_dir))


@query("anova_power_log", f"WITH {power_sql(True)} SELECT {POWER_COLUMNS} FROM study")
def anova_power_log(spark, sf_dir):
    return power_rows(power(spark, sf_dir, use_log=True))


@query(
    "min_detect_size",
    f"""WITH {power_sql()}, means AS (SELECT excl, experiment, sample_size, avg(p_value) AS mean_p FROM study GROUP BY ALL)
    SELECT excl, experiment, min(sample_size) AS sample_size, round(arg_min(mean_p, sample_size), 6) AS mean_p FROM means WHERE mean_p < 0.05 GROUP BY ALL""",
)
def min_detect_size(spark, sf_dir):
    found = statistics.smallest_detecting_size(power(spark, sf_dir), ["excl", "experiment"])
    return rounded(found, digits=6).orderBy("experiment", "excl", "sample_size")


def bootstrap_sql():
    weight = " + ".join(f"(u > {s})::INT" for s in statistics.poisson_steps())
    draw = "('0x' || substr(md5(concat_ws('/', {seed}, d, '{name}')), 1, 7))::BIGINT"
    a, b = (draw.format(seed=SEED, name=name) for name in "ab")
    return f"""WITH {power_sql()},
    numbered AS (SELECT excl, experiment, sample_size, p_value AS v,
      ('0x' || substr(md5(concat_ws('/', excl, experiment, sample_size, rep)), 1, 7))::BIGINT AS x FROM study WHERE p_value IS NOT NULL),
    factors AS (SELECT d, {a} + 1 AS fa, {b} AS fb FROM range(0, {DRAWS}) t(d)),
    weighted AS (SELECT excl, experiment, sample_size, d, v, {weight} AS w
      FROM (SELECT *, (fa * x + fb) % {statistics.PRIME} AS u FROM numbered, factors)),
    each AS (SELECT excl, experiment, sample_size, d, sum(w * v) / nullif(sum(w), 0) AS m FROM weighted GROUP BY ALL),
    bands AS (SELECT excl, experiment, sample_size, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM each GROUP BY ALL),
    means AS (SELECT excl, experiment, sample_size, avg(v) AS mean FROM numbered GROUP BY ALL)
    SELECT excl, experiment, sample_size, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high
    FROM means JOIN bands USING (excl, experiment, sample_size)"""


@query("bootstrap_band", bootstrap_sql())
def bootstrap_band(spark, sf_dir):
    bands = statistics.bootstrap_band(power(spark, sf_dir), ["excl", "experiment", "sample_size"], "p_value", ["rep"], DRAWS, seed=SEED)
    return rounded(bands, digits=6)


@query(
    "neighbour_pairs",
    f"""WITH {WALLTIMES}, t AS (SELECT DISTINCT excl, tag FROM walltimes)
    SELECT excl, tag AS group_a, lead(tag) OVER (PARTITION BY excl ORDER BY tag) AS group_b FROM t QUALIFY group_b IS NOT NULL""",
)
def neighbour_pairs(spark, sf_dir):
    return statistics.neighbours(tables.walltimes(spark, sf_dir), ["excl"], "tag")


@query(
    "paired_rows",
    f"""WITH {REPORTS}, r AS (SELECT test, branch, duration, row_number() OVER (PARTITION BY test, branch ORDER BY id) AS row_no FROM reports)
    SELECT a.test, a.row_no, a.duration AS a, b.duration AS b FROM r a JOIN r b USING (test, row_no)
    WHERE a.branch = 'master' AND b.branch = 'feature/io'""",
)
def paired_rows(spark, sf_dir):
    rows = flat(spark, sf_dir)
    return statistics.paired_rows(rows, ["test"], "branch", ("master", "feature/io"), "duration", [F.col("_id")])
