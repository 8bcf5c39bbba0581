"""Streams of report files, push events and the commit statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.sources.commits import push_triggers
from runledger.sources.reports import parse_reports
from runledger.sources.schema import PUSH
from runledger.sources.store import TableNames, save


def report_stream(spark: SparkSession, path: str, glob: str = "*.json", archive: str | None = None) -> DataFrame:
    """New report files as they arrive. The checkpoint of the query makes every file count once.

    With ``archive`` finished files are moved there as well. A file that does not parse is left out; a report of a
    failed run, without result and timers, stays. Fields are those of ``parse_reports``.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    texts = reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_path"))
    return parse_reports(texts)


def save_stream(stream: DataFrame, names: TableNames, root: str, checkpoint: str, name: str = "reports") -> StreamingQuery:
    """Save what has arrived to a project's tables, and stop. A batch that is run again leaves the same rows.

    Each micro-batch is saved under its own number, see ``store.save``; ``name`` tells streams apart.
    """

    def one(batch: DataFrame, number: int) -> None:
        save(batch, None, names, root, f"{name}-{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_reports(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to the report table, partitioned by commit day, and stop."""
    return (
        stream.withColumn("day", F.to_date("git.datetime"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def trigger_stream(spark: SparkSession, path: str, patterns: list[str] | str | None, delay: str = "1 day") -> DataFrame:
    """Runs asked for by push events, each pushed commit once within the delay.

    Events are delivered at least once; the watermark lets Spark forget old ones. It goes by the time of
    arrival: a file may be older than the events already seen.
    """
    events = spark.readStream.schema(PUSH).option("multiLine", True).json(path).withColumn("received", F.current_timestamp())
    once = events.withWatermark("received", delay).dropDuplicatesWithinWatermark(["after", "ref"])
    return push_triggers(once, patterns)


def running_commit_stats(stream: DataFrame) -> DataFrame:
    """Totals per commit and second, kept fresh; the state grows with the commits, not the reports."""
    duration = F.col("result.duration")
    return stream.groupBy(
        F.col("git.commit").alias("hash"), F.date_format("git.datetime", "yyyy-MM-dd HH:mm:ss").alias("date")
    ).agg(
        F.coalesce(F.sum(duration), F.lit(0.0)).alias("dur_sum"),
        F.avg(duration).alias("dur_avg"),
        F.max(duration).alias("dur_max"),
        F.min(duration).alias("dur_min"),
        F.count(F.lit(1)).alias("items"),
    )
