"""Tables reports are kept in, and the result store of the views."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.sizing import quoted

COMMITS, LINKS = "commits", "_of_runs"
POLICIES = ("on-error", "always", "never")


@dataclass(frozen=True)
class TableNames:
    """Tables of a project; any of them may be overridden by its configuration."""

    db_name: str
    col_timers_name: str = "timers"
    col_files_name: str = "files"
    col_history_name: str = "hist"
    col_running_name: str = "running"

    @classmethod
    def of(cls, project: str | None, overrides: dict[str, str] | None = None) -> TableNames:
        return cls(**{"db_name": project or "default", **(overrides or {})})

    def path(self, root: str, table: str) -> str:
        return f"{root.rstrip('/')}/{self.db_name}/{table}"


def keeps_logs(policy: str, problem_code: Column, result_code: Column | None = None) -> Column:
    """Whether the logs of a run are kept: on error a missing return code counts as a failure."""
    if policy not in POLICIES:
        raise ValueError(f"unknown log policy {policy!r}")
    if policy != "on-error":
        return F.lit(policy == "always")
    codes = [problem_code] if result_code is None else [problem_code, result_code]
    return F.coalesce(*codes, F.lit(1)) != 0


def file_id(path: Column, data: Column) -> Column:
    """Id of a stored file: a digest, so writing a run again gives the same id."""
    return F.sha2(F.concat(path.cast("binary"), F.lit(b"\0"), F.coalesce(data, F.lit(b""))), 256)


def log_files(runs: DataFrame, files: DataFrame, policy: str, run_key: str = "run_id") -> DataFrame:
    """Files to store: the logs of the runs whose policy keeps them, with their ids and sizes.

    Runs without logs give no rows; a run with many logs gives many rows, never one list.
    """
    problem_code = F.col("problem.returncode")
    result_code = F.col("result.returncode")
    kept = runs.where(keeps_logs(policy, problem_code, result_code)).select(F.col(quoted(run_key)).alias("__run"))
    rows = files.join(_shuffled(kept), files[quoted(run_key)] == kept["__run"], "left_semi")
    return rows.select(
        run_key,
        "filename",
        file_id(F.col("filename"), F.col("data")).alias("file_id"),
        F.coalesce(F.length("data"), F.lit(0)).cast("bigint").alias("filesize"),
        "data",
    )


def report_ids(reports: DataFrame) -> DataFrame:
    """Reports with an ``_id`` each: their own, or else a digest of all they hold, their source path included."""
    content = F.to_json(F.struct(*[F.col(quoted(c)) for c in sorted(reports.columns) if c != "_id"]))
    digest = F.sha2(content, 256)
    own = F.col("_id").cast("string") if "_id" in reports.columns else F.lit(None).cast("string")
    return reports.withColumn("_id", F.coalesce(own, digest))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of batches, or None where nothing was written yet."""
    try:
        return spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _committed(spark: SparkSession, names: TableNames, root: str, table: str) -> DataFrame | None:
    """Rows of the batches whose save came to its end."""
    rows, done = _read(spark, names.path(root, table)), _read(spark, names.path(root, COMMITS))
    if rows is None or done is None:
        return None
    # The batch is a partition column: Spark prunes folders by the few committed names.
    finished = done.select(F.col("batch").alias("__done")).distinct()
    return rows.join(finished, F.col("batch") == F.col("__done"), "left_semi").drop("batch")


def saved_reports(spark: SparkSession, names: TableNames, root: str) -> DataFrame | None:
    """Reports of all finished saves; None before the first."""
    return _committed(spark, names, root, names.col_timers_name)


def saved_logs(spark: SparkSession, names: TableNames, root: str) -> DataFrame | None:
    """Logs of all finished saves with the runs they belong to: ``run_id``, ``filename``, ``filesize``, ``data``."""
    links, files = (_committed(spark, names, root, t) for t in (names.col_files_name + LINKS, names.col_files_name))
    if links is None or files is None:
        return None
    return links.join(files.select("file_id", "data"), "file_id")


def _shuffled(keys: DataFrame) -> DataFrame:
    """A side of a join that never goes through the driver.

    Spark guesses the size of a few columns by their share of a row, where a VARIANT counts 2 KB: millions of keys
    out of reports pass for small, and would be broadcast.
    """
    return keys.hint("merge")


def _new(rows: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """Each row once by its keys, without those already there."""
    if old is None:
        return rows.dropDuplicates(keys)
    # No join: rows of a key meet before the shuffle, so that a common key is no work for one task.
    row = F.struct(*[F.col(quoted(c)) for c in rows.columns if c not in keys]).alias("__row")
    both = rows.select(*keys, row, F.lit(False).alias("__known")).unionByName(old.select(*keys, F.lit(True).alias("__known")), allowMissingColumns=True)
    found = both.groupBy(*keys).agg(F.max("__known").alias("__known"), F.first("__row", ignorenulls=True).alias("__row"))
    return found.where(~F.col("__known")).select(*[F.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in rows.columns])


def save(reports: DataFrame, logs: DataFrame | None, names: TableNames, root: str, batch: str | None = None) -> str:
    """Save a batch of reports and logs so that saving them again leaves the same rows; gives the name of the batch.

    Logs come first, then the links that name the files of a run, then the reports, then the batch's entry in the
    table of commits. Readers (``saved_reports``, ``saved_logs``) see committed batches only, so neither a report
    before its logs nor what a broken save left; that is overwritten when the batch is saved again. A committed batch
    is not saved twice. Reports are known by id, files and links by theirs: those in earlier batches are left out,
    whatever batch they came in. An id has one commit day. Reports without ``_id`` get a digest of their content for one.

    Batches of one project are saved one after another. Reports are partitioned by batch and commit day, so that
    only the days of the new reports are compared.
    """
    # The prefix keeps Spark from taking a name for a number.
    spark, batch = reports.sparkSession, f"b-{batch or uuid.uuid4().hex}"
    done = _read(spark, names.path(root, COMMITS))
    if done is not None and not done.where(F.col("batch") == batch).isEmpty():
        return batch

    def write(rows: DataFrame, table: str, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{names.path(root, table)}/batch={batch}")

    if logs is not None:
        files, links = names.col_files_name, names.col_files_name + LINKS
        write(_new(logs.select("file_id", "filename", "data"), _committed(spark, names, root, files), ["file_id"]), files)
        write(_new(logs.select("run_id", "filename", "file_id", "filesize"), _committed(spark, names, root, links), ["run_id", "file_id"]), links)
    rows = report_ids(reports).withColumn("day", F.to_date("git.datetime"))
    old = saved_reports(spark, names, root)
    if old is not None:
        # A batch has few commit days; named in a filter they prune the partitions.
        days = [r["day"] for r in rows.select("day").distinct().collect()]
        day = F.col("day").cast("date")
        old = old.where(day.isin([d for d in days if d is not None]) | (day.isNull() if None in days else F.lit(False)))
    # Rebalancing by day keeps the files few, and splits a day that holds much of the data.
    write(_new(rows, old, ["_id"]).hint("rebalance", "day"), names.col_timers_name, "day")
    spark.range(0, 1, 1, 1).select(F.current_timestamp().alias("saved_at")).write.mode("overwrite").parquet(f"{names.path(root, COMMITS)}/batch={batch}")
    return batch


def find(reports: DataFrame, condition: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = reports if condition is None else reports.where(condition)
    return rows if columns is None else rows.select(*columns)


def find_one(reports: DataFrame, condition: Column | None = None) -> DataFrame:
    return find(reports, condition).limit(1)


def version(spark: SparkSession, names: TableNames, root: str) -> str:
    """What a project's tables hold, in a word: it changes with each finished save."""
    done = _read(spark, names.path(root, COMMITS))
    if done is None:
        return "0"
    count, mixed = done.select("batch").distinct().agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("batch"))).first()
    return f"{count}-{mixed}"


class ResultStore:
    """View results kept as tables under a shared folder, keyed by project, options and the version of the reports."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, project: str, options: dict, build: Callable[[], DataFrame], version: str = "") -> DataFrame:
        """The stored result, or the built one after storing it.

        Give the ``version`` of the tables that the result is built from: a result of another version is not taken,
        so a view is fresh after each save. A result whose writing broke off is written anew.
        """
        text = json.dumps([project, options, version], sort_keys=True, default=str)
        path = f"{self.root}/{hashlib.sha256(text.encode()).hexdigest()}"
        if _read(self.spark, f"{path}/done") is None:
            build().write.mode("overwrite").parquet(f"{path}/rows")
            self.spark.range(0, 1, 1, 1).write.mode("overwrite").parquet(f"{path}/done")
        return self.spark.read.parquet(f"{path}/rows")
