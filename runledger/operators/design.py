"""Experiment designs, and what a history of reports still lacks for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from runledger.sizing import keyed_join, quoted


def matrix(df: DataFrame, variables: dict[str, Column]) -> DataFrame:
    """All combinations of the variables' lists for every section row, in nested order.

    Adds ``current`` (from 1) and ``total``. Lists are exploded one after another inside their row, so
    there is no join and no shuffle; the position follows from the list sizes.
    """
    names = list(variables)
    result = df.withColumns({f"__list_{n}": c for n, c in variables.items()})
    total = reduce(lambda a, n: a * F.size(F.col(quoted(f"__list_{n}"))).cast("bigint"), names, F.lit(1).cast("bigint"))
    result = result.withColumn("total", total).withColumn("current", F.lit(0).cast("bigint"))
    for n in names:
        listed = quoted(f"__list_{n}")
        result = result.select("*", F.posexplode(listed).alias("__pos", n)).withColumn(
            "current", F.col("current") * F.size(listed) + F.col("__pos")
        ).drop("__pos")
    return result.withColumn("current", F.col("current") + 1).drop(*[f"__list_{n}" for n in names])


def zipped(df: DataFrame, variables: dict[str, Column], scalars: dict[str, Column] | None = None) -> DataFrame:
    """Lists of a section side by side, scalars repeated; unequal lists are an error.

    Adds ``current`` (from 1) and ``total``.
    """
    names = list(variables)
    sizes = F.array_distinct(F.array(*[F.size(c) for c in variables.values()]))
    checked = F.when(F.size(sizes) == 1, F.arrays_zip(*[c.alias(n) for n, c in variables.items()])).otherwise(
        F.raise_error(F.lit("the lists of a zipped design differ in length"))
    )
    result = df.withColumn("__rows", checked).select("*", F.size("__rows").cast("bigint").alias("total"), F.posexplode("__rows").alias("__pos", "__row"))
    fields = {n: F.col("__row").getField(n) for n in names}
    return result.withColumns({**fields, **(scalars or {}), "current": (F.col("__pos") + 1).cast("bigint")}).drop("__rows", "__row", "__pos")


def sections(*parts: DataFrame) -> DataFrame:
    """Designs one under another; variables a section lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def repeat_spec(spec: int | dict | None) -> tuple[int, bool]:
    """Repetitions asked for, and whether found reports count towards them."""
    if isinstance(spec, bool):
        raise ValueError("the repetition must be a number or a mapping")
    if spec is None:
        return 1, False
    if isinstance(spec, int):
        return max(spec, 1), False
    if isinstance(spec, dict):
        at_least = spec.get("no-less-than")
        exactly = spec.get("exactly", at_least)
        if exactly is None:
            raise ValueError('give "exactly" and/or "no-less-than"')
        value = exactly if at_least is None else at_least
        return max(value or 1, 1), at_least is not None
    raise ValueError("the repetition must be a number or a mapping")


def index_counts(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports found per index; one aggregate instead of a query per configuration."""
    return reports.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("found"))


def remaining_runs(plan: DataFrame, found: DataFrame, keys: list[str], spec: int | dict | None) -> DataFrame:
    """Add ``found`` and ``remaining`` to each planned configuration.

    ``found`` is already one row per index, so neither side has a hot key.
    """
    wanted, dynamic = repeat_spec(spec)
    joined = keyed_join(plan, found, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    remaining = F.greatest(F.lit(wanted) - F.col("found"), F.lit(0)) if dynamic and keys else F.lit(wanted)
    return joined.withColumn("remaining", remaining.cast("bigint"))


def run_tasks(plan: DataFrame, repeat: str = "remaining") -> DataFrame:
    """One row per configuration and repetition (from 1); nothing for configurations that are done."""
    todo = plan.where(F.col(repeat) > 0)
    return todo.withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(repeat))))


def commit_backlog(commits: DataFrame, plan: DataFrame, found: DataFrame, commit: str, keys: list[str], spec: int | dict | None) -> DataFrame:
    """Per commit: configurations still short of repetitions, and whether it has to be run.

    Instead of pairing every commit with every configuration, the filled configurations of a commit
    are counted and taken from the size of the plan.
    """
    wanted, dynamic = repeat_spec(spec)
    configurations = plan.select(*[F.col(quoted(k)) for k in keys]).distinct()
    total = configurations.count()
    planned = keyed_join(found, configurations, keys)
    enough = F.col("found") >= wanted
    progress = planned.groupBy(F.col(quoted(commit))).agg(
        F.count(F.when(enough, 1)).alias("done"), F.sum(F.when(~enough, F.col("found"))).alias("partly")
    )
    unique = commits.select(F.col(quoted(commit))).distinct()
    joined = keyed_join(unique, progress, [commit], "left")
    finished = F.coalesce(F.col("done"), F.lit(0)) if dynamic else F.lit(0)
    short = F.lit(total) - finished
    missing = short * wanted - (F.coalesce(F.col("partly"), F.lit(0)) if dynamic else F.lit(0))
    return joined.select(
        F.col(quoted(commit)),
        short.cast("bigint").alias("short"),
        missing.cast("bigint").alias("missing_runs"),
        (short > 0).alias("need_run"),
    )


def effort_estimate(history: DataFrame, keys: list[str], reps: str, duration: str, wanted: int) -> DataFrame:
    """Seconds left per key: time per past repetition times the repetitions still missing."""
    columns = [F.col(quoted(k)) for k in keys]
    totals = history.groupBy(*columns).agg(
        F.coalesce(F.sum(reps), F.lit(0)).alias("reps"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("duration")
    )
    remaining = F.greatest(F.lit(wanted) - F.col("reps"), F.lit(0)).cast("bigint")
    per_rep = F.when((F.col("reps") > 0) & (F.col("duration") > 0), F.try_divide("duration", "reps"))
    return totals.withColumn("remaining", remaining).withColumn("seconds_left", per_rep * F.col("remaining"))
