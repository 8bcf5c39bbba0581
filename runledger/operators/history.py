"""Selection of commits from a log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from runledger.operators.filters import newer_than
from runledger.operators.ordering import first_rows, previous_value
from runledger.sizing import quoted

POLICIES = ("every-commit", "commit-per-day")


def pick_commits(
    df: DataFrame, keys: list[str], order: list[Column], day: str, policy: str = "every-commit"
) -> DataFrame:
    """Commits to test: all of them, or the first of every run of consecutive commits of one day.

    The first of a run is the commit whose day differs from the commit before it in log order.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown commit policy {policy!r}")
    if policy == "every-commit":
        return df
    marked = previous_value(df, keys, order, day, "__before")
    return marked.where(~F.col("__before").eqNullSafe(F.col(quoted(day)))).drop("__before")


def latest_per_branch(df: DataFrame, branch: str, order: list[Column], n: int = 10) -> DataFrame:
    return first_rows(df, [branch], order, n)


def latest_commits(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def active_branches(df: DataFrame, branch: str, time: str, as_of: dt.datetime, months: int = 6) -> DataFrame:
    """Branches whose newest commit is not older than the given months before ``as_of``."""
    newest = df.groupBy(F.col(quoted(branch)).alias(branch)).agg(F.max(quoted(time)).alias("date"))
    return newest.where(newer_than(F.col("date"), as_of, months))


def unique_commits(df: DataFrame, commit: str, branch: str, time: str) -> DataFrame:
    """Each commit once, with its date and the first of its branches."""
    return df.groupBy(F.col(quoted(commit)).alias(commit)).agg(
        F.max(quoted(time)).alias("date"), F.min(quoted(branch)).alias("branch"), F.count(F.lit(1)).alias("seen")
    )


def sample_per_group(df: DataFrame, keys: list[str], n: int, unique: str, seed: int = 1234) -> DataFrame:
    """``n`` random rows of each group, the same on every run of a seed."""
    chance = F.md5(F.concat_ws("/", F.col(quoted(unique)).cast("string"), F.lit(str(seed))))
    return first_rows(df, keys, [chance, F.col(quoted(unique))], n)
