"""Commit logs and push events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.functions.dates import file_stamp, from_epoch
from runledger.functions.text import strip_prefix
from runledger.operators.filters import branch_matches
from runledger.sources.schema import PUSH


def parse_log_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Commits out of ``hash|short|author|email|age|time|refs|message`` lines; a message may hold bars."""
    parts = F.split(line, r"\|", 8)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    time = part(6).try_cast("bigint")
    others = [c for c in df.columns if c != line]
    return df.select(
        *others,
        part(1).alias("hash"),
        part(2).alias("short_hash"),
        part(3).alias("author"),
        part(4).alias("email"),
        part(5).alias("rel_date"),
        time.alias("timestamp"),
        file_stamp(from_epoch(time)).alias("fs_date"),
        F.split(part(7), ", ").alias("refs"),
        part(8).alias("message"),
    ).where(F.col("timestamp").isNotNull())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def parse_push_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed push events out of JSON text; fields of a wrong type become null."""
    others = [c for c in df.columns if c != payload]
    parsed = df.withColumn("event", F.from_json(payload, PUSH))
    return parsed.select(*others, "event.*")


def push_triggers(events: DataFrame, patterns: list[str] | str | None) -> DataFrame:
    """Runs that push events ask for: project, commit, branch and address, where the branch matches."""
    return events.where(F.col("after").isNotNull() & branch_matches(F.col("ref"), patterns)).select(
        F.col("repository.name").alias("project"),
        F.col("after").alias("commit"),
        short_branch(F.col("ref")).alias("branch"),
        F.col("repository.html_url").alias("url"),
    )


def short_branch(ref: Column) -> Column:
    return strip_prefix(ref, "refs/heads/")
