"""Tests of whether a change of run time is real.

Every test starts from mergeable moments per group, so one pass with map-side combining is enough and
the p-values are computed on the few rows that remain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from runledger.functions.numbers import logarithm
from runledger.functions.tails import chi2_tail, f_tail, t_tail
from runledger.operators.aggregates import no_null_keys
from runledger.operators.ordering import previous_value, running_total
from runledger.operators.quantiles import group_percentiles
from runledger.session import stored
from runledger.sizing import keyed_join, quoted


def anova(df: DataFrame, tests: list[str], group: str, value: str, p_value: bool = True) -> DataFrame:
    """One-way analysis of variance of ``value`` over the levels of ``group``, per test.

    Variances come from Spark's stable central moments, not from raw sums of squares.
    """
    columns = [F.col(quoted(k)) for k in tests]
    v = F.col(quoted(value)).cast("double")
    levels = (
        no_null_keys(df, [*tests, group, value])
        .groupBy(*columns, F.col(quoted(group)))
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    )
    # Between-group squares as weighted central moments of the means about the first mean.
    shifts = levels.groupBy(*columns).agg(F.min("mean").alias("origin"))
    joined = keyed_join(levels, shifts, tests).withColumn("m", F.col("mean") - F.col("origin"))
    totals = joined.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    dfb, dfw = (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within")
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    result = totals.select(*columns, dfb, dfw, f.alias("f"))
    if p_value:
        p = f_tail(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
        result = result.withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))
    return result


def normality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D'Agostino's test from skewness and kurtosis; below eight values the p-value is 0."""
    columns = [F.col(quoted(k)) for k in keys]
    v = F.col(quoted(value)).cast("double")
    moments = no_null_keys(df, [*keys, value]).groupBy(*columns).agg(
        F.count(v).cast("double").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("g1"),
        (F.kurtosis(v) + 3.0).alias("b2"),
    )
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    enough = n >= 8

    # Skewness score.
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta - 1)) - 1
    scaled = y / F.sqrt(2.0 / (w2 - 1))
    z1 = F.asinh(scaled) / F.sqrt(0.5 * F.ln(w2))

    # Kurtosis score.
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    denominator = 1 + x * F.sqrt(2.0 / (a - 4))
    cube = F.when(denominator == 0, None).otherwise(F.signum(denominator) * F.cbrt((1 - 2.0 / a) / F.abs(denominator)))
    z2 = (1 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))

    usable = enough & (F.col("std") > 0)
    k2 = F.when(usable, z1 * z1 + z2 * z2)
    scored = moments.select(*columns, F.col("n").cast("bigint").alias("n"), "mean", "std", k2.alias("k2"))
    # Chi-square with two degrees of freedom has a closed tail.
    return scored.withColumn("p_value", F.coalesce(F.exp(-F.col("k2") / 2.0), F.lit(0.0)))


def welch_against_baseline(df: DataFrame, tests: list[str], setting: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of every setting against the smallest setting of its test.

    Group moments are compared, one row per setting; all pairs of settings are not formed.
    """
    columns = [F.col(quoted(k)) for k in tests]
    v = F.col(quoted(value)).cast("double")
    stats = (
        no_null_keys(df, [*tests, setting, value])
        .groupBy(*columns, F.col(quoted(setting)))
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    )
    base = stats.groupBy(*columns).agg(
        F.min_by(F.struct(F.col(quoted(setting)).alias("setting"), "n", "mean", "var"), quoted(setting)).alias("base")
    )
    joined = keyed_join(stats, base, tests).where(F.col("base.setting") != F.col(quoted(setting)))
    ea, eb = F.col("base.var") / F.col("base.n"), F.col("var") / F.col("n")
    t = F.try_divide(F.col("base.mean") - F.col("mean"), F.sqrt(ea + eb))
    dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("base.n") - 1) + eb * eb / (F.col("n") - 1))
    scored = joined.where((F.col("base.n") > 1) & (F.col("n") > 1)).select(
        *columns,
        F.col("base.setting").alias("setting_a"),
        F.col(quoted(setting)).alias("setting_b"),
        F.col("base.mean").alias("mean_a"),
        F.col("mean").alias("mean_b"),
        t.alias("t"),
        dof.alias("dof"),
    )
    p = F.nanvl(t_tail(F.col("t"), F.col("dof")), F.lit(None).cast("double"))
    return scored.withColumn("p_value", p).withColumn("reject", F.col("p_value") <= alpha)


def kruskal(df: DataFrame, tests: list[str], group: str, value: str) -> DataFrame:
    """Kruskal–Wallis statistic with tie correction, per test.

    Equal values are counted first; the ranks then follow from a running total of those counts.
    """
    columns = [F.col(quoted(k)) for k in tests]
    rows = no_null_keys(df, [*tests, group, value])
    v = F.col(quoted(value))
    ties = rows.groupBy(*columns, v.alias("__v")).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = running_total(ties, tests, [F.col("__v")], F.col("__ties"), "__upto").withColumn(
        "__rank", F.col("__upto") - (F.col("__ties") - 1) / 2
    )
    per_level = rows.groupBy(*columns, F.col(quoted(group)), v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    level_ranks = (
        keyed_join(per_level, ranked, [*tests, "__v"])
        .withColumn("__sum", F.col("__c") * F.col("__rank"))
        .groupBy(*columns, F.col(quoted(group)))
        .agg(F.sum("__c").cast("double").alias("n"), F.sum("__sum").alias("ranks"))
    )
    sums = level_ranks.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("r2")
    )
    t = F.col("__ties").cast("double")
    tie_sums = ties.groupBy(*columns).agg(F.sum(t * t * t - t).alias("tied"))
    joined = keyed_join(sums, tie_sums, tests)
    n = F.col("n")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("r2") - 3.0 * (n + 1)
    h = F.try_divide(raw, 1.0 - F.try_divide(F.col("tied"), n * n * n - n))
    return joined.select(*columns, (F.col("k") - 1).alias("dof"), n.cast("bigint").alias("n"), h.alias("h"))


def _hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of parts joined by slashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def kruskal_decision(df: DataFrame, tests: list[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """The Kruskal–Wallis statistic of each test with its ``p_value``, and ``reject``: whether its levels differ.

    All tests together err with a probability of at most ``alpha``: from the smallest p-value on, each is held against
    ``alpha`` over the number of tests left, until one fails. A test whose values are all equal, or that has one
    level, has neither a statistic nor a p-value and is not rejected.
    """
    rows = kruskal(df, tests, group, value)
    p = F.nanvl(chi2_tail(F.col("h"), F.col("dof").cast("double")), F.lit(None).cast("double"))
    # One row per test: the order over all of them is one over results, not over measurements.
    scored = stored(rows.withColumn("p_value", p), "kruskal")
    tested = scored.where("p_value is not null").select(*[F.col(quoted(k)) for k in tests], "p_value")
    ranked = running_total(tested, [], [F.col("p_value"), *[F.col(quoted(k)) for k in tests]], name="__at")
    fails = F.col("p_value") > F.lit(alpha) / (F.lit(tested.count()) - F.col("__at") + 1)
    failed = ranked.where(fails).agg(F.min("__at")).first()[0]
    decided = ranked.select(*[F.col(quoted(k)) for k in tests], (F.lit(True) if failed is None else F.col("__at") < failed).alias("reject"))
    return keyed_join(scored, decided, tests, "left").withColumn("reject", F.coalesce("reject", F.lit(False)))


def permuted(df: DataFrame, index: str, size: str, key: list[Column], name: str, rounds: int = 4) -> DataFrame:
    """A keyed permutation: the column ``name`` is the place in 0 .. a * b - 1 that an index of that range moves to.

    Here a is the root of ``size`` rounded up and a * b the next multiple of it from ``size`` on; places from ``size``
    on are to be left out. A Feistel network: the halves of the index in turn move by a hash of the other one, so
    each round can be undone, and no two indexes share a place.
    """
    a, b, low, high = (F.col(c) for c in ("__a", "__b", "__low", "__high"))
    rows = df.withColumn("__a", F.ceil(F.sqrt(F.col(size).cast("double"))))
    rows = rows.withColumn("__b", F.ceil(F.col(size) / a))
    rows = rows.withColumns({"__low": F.col(index) % a, "__high": F.floor(F.col(index) / a)})
    for number in range(rounds):
        if number % 2 == 0:
            rows = rows.withColumn("__low", (low + _hashed(*key, F.lit(number), high) % a) % a)
        else:
            rows = rows.withColumn("__high", (high + _hashed(*key, F.lit(number), low) % b) % b)
    return rows.withColumn(name, high * a + low).drop("__a", "__b", "__low", "__high")


def sampling_design(df: DataFrame, labels: list[str], sizes: list[int], reps: int, seed: int) -> DataFrame:
    """Draws of a Monte Carlo comparison: the labels, ``rep``, ``side`` (a or b), ``place`` from 1, ``row_no`` from 1.

    ``df`` has one row per experiment with ``n_a`` and ``n_b``, the sizes of its groups. A repetition permutes the
    row numbers of each group, so its sample of one size is the beginning of that of the next. Places go up to the
    largest size that both groups have rows for.
    """
    most = F.array_max(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (s <= F.col("n_a")) & (s <= F.col("n_b"))))
    cells = df.withColumn("most", most.cast("long")).where("most is not null")
    cells = cells.select(*labels, "most", "n_a", "n_b", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    side = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"n_{x}").alias("n")) for x in "ab"])
    cells = cells.select(*labels, "most", "rep", F.explode(side).alias("s")).select(*labels, "most", "rep", "s.*")
    # The range permuted is longer than the group by less than its root. So many more indexes always give enough
    # places; where that is more than the places wanted, the groups are so large that twice as many do, but for
    # odds of less than 1e-100.
    root = F.ceil(F.sqrt(F.col("n").cast("double")))
    spare = root * F.ceil(F.col("n") / root) - F.col("n")
    drawn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") + F.least(spare, F.col("most")) - 1))
    key = [F.lit(seed), *[F.col(quoted(c)) for c in labels], F.col("side"), F.col("rep")]
    # Repetitions are spread before they are drawn: they stem from few rows, and are small until then.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = cells.repartition(parts, *labels, "rep", "side").select("*", drawn.alias("index"))
    moved = permuted(drawn, "index", "n", key, "moved").withColumn("row_no", F.col("moved") + 1)
    # Filtered after the window: a filter below it would be computed by hashing all rounds anew.
    order = Window.partitionBy(*labels, "rep", "side").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("row_no") <= F.col("n")
    placed = moved.withColumn("place", F.sum(fits.cast("int")).over(order)).where(fits & (F.col("place") <= F.col("most")))
    return placed.select(*labels, "rep", "side", "place", "row_no")


def anova_power(
    df: DataFrame,
    experiments: DataFrame,
    keys: list[str],
    group: str,
    value: str,
    order: list[Column],
    sizes: list[int],
    reps: int,
    seed: int = 1234,
    use_log: bool = False,
) -> DataFrame:
    """p-values of repeated two-sample comparisons at every sample size, with the means of both samples.

    ``experiments`` holds ``experiment``, the keys, ``group_a`` and ``group_b``; a group compared with itself is a
    control. Rows are numbered once in their group and fetched by number. A row fetched counts once: sums over the
    places between two sizes are added up along the sizes.
    """
    columns = [F.col(quoted(k)) for k in [*keys, group]]
    labels = ["experiment", *keys]
    measured = F.col(quoted(value)).cast("double")
    rows = no_null_keys(df, [*keys, group, value])
    ordered = [o.alias(f"__order{i}") for i, o in enumerate(order)]
    rows = rows.select(*columns, *ordered, (logarithm(measured) if use_log else measured).alias("measured"))
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.avg("measured").alias("centre"))
    groups = [F.col(quoted(k)) for k in keys]
    a = counts.select(*groups, F.col(quoted(group)).alias("group_a"), F.col("n").alias("n_a"), "centre")
    b = counts.select(*groups, F.col(quoted(group)).alias("group_b"), F.col("n").alias("n_b"))
    sized = experiments.join(a, [*keys, "group_a"]).join(b, [*keys, "group_b"])
    draws = sampling_design(sized, labels, sizes, reps, seed).join(sized.select(*labels, "group_a", "group_b", "centre"), labels)
    draws = draws.withColumn(group, F.when(F.col("side") == "a", F.col("group_a")).otherwise(F.col("group_b")))
    numbered = running_total(rows, [*keys, group], [F.col(f"__order{i}") for i in range(len(order))], name="row_no")
    picked = draws.join(numbered.select(*columns, "row_no", "measured"), [*keys, group, "row_no"])
    # Distances to a group's mean: their squares add up without loss.
    x, in_a = F.col("measured") - F.col("centre"), F.col("side") == "a"
    size = F.array_min(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("place")))
    sums = {"a": F.when(in_a, x), "b": F.when(~in_a, x), "aa": F.when(in_a, x * x), "bb": F.when(~in_a, x * x)}
    steps = picked.groupBy(*labels, "rep", size.alias("sample_size")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for name, c in sums.items()], F.first("centre").alias("centre")
    )
    upto = Window.partitionBy(*labels, "rep").orderBy("sample_size").rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.select(*labels, "rep", "sample_size", "centre", *[F.sum(name).over(upto).alias(name) for name in sums])
    n, sa, sb = F.col("sample_size"), F.col("a"), F.col("b")
    within = F.greatest(F.col("aa") - sa * sa / n + F.col("bb") - sb * sb / n, F.lit(0.0))
    between = (sa - sb) * (sa - sb) / (2 * n)
    f = F.try_divide(between, F.try_divide(within, 2.0 * n - 2))
    p = f_tail(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return totals.select(
        *labels,
        "sample_size",
        "rep",
        F.lit(1).cast("long").alias("df_between"),
        (2 * n - 2).cast("long").alias("df_within"),
        f.alias("f"),
        (F.col("centre") + sa / n).alias("mean_a"),
        (F.col("centre") + sb / n).alias("mean_b"),
    ).withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))


def smallest_detecting_size(p_values: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Smallest sample size whose mean p-value is below alpha, with that mean."""
    columns = [F.col(quoted(k)) for k in keys]
    means = p_values.groupBy(*columns, "sample_size").agg(F.avg("p_value").alias("mean_p"))
    return (
        means.where(F.col("mean_p") < alpha)
        .groupBy(*columns)
        .agg(F.min("sample_size").alias("sample_size"), F.min_by("mean_p", "sample_size").alias("mean_p"))
    )


PRIME = (1 << 31) - 1


def poisson_steps(mean: float = 1.0) -> list[int]:
    """Numbers in 0 .. ``PRIME`` - 1 above which a uniform number stands for a weight of 1, 2, ... of that mean."""
    out, mass, total, k = [], exp(-mean), exp(-mean), 0
    while int(total * PRIME) < PRIME - 1 and mass > 1e-12:
        out.append(int(total * PRIME))
        k += 1
        mass *= mean / k
        total += mass
    return out


def draw_factors(draws: int, seed: int) -> list[tuple[int, int]]:
    """Factor and shift of each draw's hash x -> (factor * x + shift) mod ``PRIME``."""
    digests = [[hashlib.md5(f"{seed}/{d}/{name}".encode()).hexdigest()[:7] for name in "ab"] for d in range(draws)]
    return [(int(a, 16) + 1, int(b, 16)) for a, b in digests]


def bootstrap_band(
    df: DataFrame, keys: list[str], value: str, row: list[str] | None = None, draws: int = 1000, confidence: float = 0.9, seed: int = 1234
) -> DataFrame:
    """Mean of each group with its bootstrap interval.

    Instead of picking rows, each draw weights every row by a Poisson number of mean one, which does not ask how many
    rows a group has. A weight is a hash of the draw and of the row, told apart by the columns ``row``, or else by its
    place in the input. Tasks add up
    weights and weighted values of all draws in arrays of fixed length, a row per group and batch; these are summed
    per draw. So rows are read once, and neither gathered nor multiplied.
    """
    columns = [F.col(quoted(k)) for k in keys]
    rows = no_null_keys(df, [*keys, value])
    own = [F.monotonically_increasing_id()] if row is None else [F.col(quoted(c)) for c in row]
    name = F.concat_ws("/", *columns, *[F.coalesce(c.cast("string"), F.lit("")) for c in own])
    number = F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")
    rows = rows.select(*columns, F.col(quoted(value)).cast("double").alias("__v"), number.alias("__x"))
    factors, steps = np.array(draw_factors(draws, seed), np.int64), poisson_steps()
    kept = [f for f in rows.schema.fields if f.name in keys]
    schema = StructType([*kept, *(StructField(n, ArrayType(DoubleType())) for n in ("__sums", "__weights"))])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, part in batch.groupby(keys, sort=False):
                sums, weights = np.zeros(draws), np.zeros(draws)
                for at in range(0, len(part), 1024):
                    x, v = (part[c].to_numpy()[at : at + 1024] for c in ("__x", "__v"))
                    chance = (x[:, None] * factors[:, 0] + factors[:, 1]) % PRIME
                    weight = np.searchsorted(steps, chance, "left").astype(np.float64)
                    sums += v @ weight
                    weights += weight.sum(axis=0)
                out.append((*group, sums, weights))
            yield pd.DataFrame(out, columns=schema.names)

    arrays = rows.mapInPandas(add_up, schema)
    pairs = F.posexplode(F.arrays_zip("__sums", "__weights"))
    each = arrays.select(*columns, pairs.alias("__draw", "__pair")).groupBy(*columns, "__draw").agg(
        F.try_divide(F.sum("__pair.__sums"), F.sum("__pair.__weights")).alias("__mean")
    )
    edge = (1.0 - confidence) / 2.0
    # A group has as many means as there are draws: few, whatever its rows.
    bands = each.groupBy(*columns).agg(F.percentile("__mean", F.array(F.lit(edge), F.lit(1.0 - edge))).alias("__band"))
    means = rows.groupBy(*columns).agg(F.avg("__v").alias("mean"))
    return keyed_join(means, bands, keys).select(*columns, "mean", F.col("__band")[0].alias("low"), F.col("__band")[1].alias("high"))


def neighbours(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Each distinct level with the next one: the pairs a change is looked for between."""
    columns = [F.col(quoted(k)) for k in keys]
    levels = no_null_keys(df, [*keys, level]).select(*columns, F.col(quoted(level)).alias("group_a")).distinct()
    paired = previous_value(levels, keys, [F.desc("group_a")], "group_a", "group_b")
    return paired.where("group_b is not null")


def paired_rows(
    df: DataFrame, keys: list[str], group: str, levels: tuple, value: str, order: list[Column]
) -> DataFrame:
    """Values of two groups side by side by position; the longer group is cut to the shorter one."""
    columns = [F.col(quoted(k)) for k in keys]
    rows = no_null_keys(df, [*keys, group]).where(F.col(quoted(group)).isin(*levels))
    numbered = running_total(rows, [*keys, group], order, name="row_no")

    def side(level: object, name: str) -> DataFrame:
        chosen = numbered.where(F.col(quoted(group)) == F.lit(level))
        return chosen.select(*columns, "row_no", F.col(quoted(value)).alias(name))

    return keyed_join(side(levels[0], "a"), side(levels[1], "b"), [*keys, "row_no"])
