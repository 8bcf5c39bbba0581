"""Intake operators over texts and events of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import COMMITS, REPORTS, query
from runledger.session import shared_folder, stored
from runledger.sizing import spread
from runledger.sources import commits as commit_sources
from runledger.sources import reports as report_sources
from runledger.sources import store, tables
from runledger.sources.shred import member

MARK = "-" * 20


@query(
    "cut_reports",
    f"""WITH d AS (SELECT doc_id, text, lang, n_chars FROM documents)
    SELECT doc_id, 'parse-result-01' AS name, '{{"lang": "' || lang || '"}}' AS content FROM d
    UNION ALL SELECT doc_id, 'parse-result-02', regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM d WHERE n_chars % 3 <> 0""",
)
def cut_reports(spark, sf_dir):
    """Two marked reports in a captured output; in a third of them the second one is cut off."""
    output = F.concat(
        F.lit(f"starting\n{MARK}\n"),
        F.lit('{"lang": "'), "lang", F.lit('"}'),
        F.lit(f"\n{MARK}\nbetween\n{MARK}\n"),
        "text",
        F.when(F.col("n_chars") % 3 != 0, F.lit(f"\n{MARK}\nend")).otherwise(""),
    )
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", output.alias("output"))
    return report_sources.cut_reports(rows, "output", MARK, MARK)


def report_texts(spark, sf_dir, kind):
    """Report texts of all runs; those of failed runs are truncated."""
    rows = spread(tables.reports(spark, sf_dir))
    body = F.to_json(F.struct("problem", "result", "timers"))
    if kind == "yaml":
        body = F.format_string(
            "problem:\n  cpu: %d\n  stage: %s\nresult: {duration: %s}\ntimers:\n- name: whole\n  duration: %s\n",
            F.col("problem.cpu"), F.col("problem.test-name"), F.col("result.duration"), F.col("result.duration"),
        )
        broken = F.concat(F.lit("a: [1, 2"), F.lit("\nb: }"))
    else:
        broken = F.substr(body, F.lit(1), F.length(body) - 7)
    failed = F.col("result.returncode") == 1
    return rows.select("_id", F.when(failed, broken).otherwise(body).alias("content"))


@query(
    "parse_json_reports",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, duration, 3 AS timers FROM reports WHERE returncode = 0""",
)
def parse_json_reports(spark, sf_dir):
    rows = report_sources.parse_reports(report_texts(spark, sf_dir, "json"))
    return rows.select("_id", F.col("problem.test-name").alias("test"), "problem.cpu", "result.duration", F.size("timers").alias("timers"))


@query(
    "parse_yaml_reports",
    f"""WITH {REPORTS} SELECT id AS _id, test, cpu, duration, 1 AS timers FROM reports WHERE returncode = 0""",
)
def parse_yaml_reports(spark, sf_dir):
    rows = report_sources.parse_reports(report_texts(spark, sf_dir, "yaml"), kind="yaml")
    return rows.select("_id", F.col("problem.stage").alias("test"), "problem.cpu", "result.duration", F.size("timers").alias("timers"))


def full_texts(spark, sf_dir):
    """Report texts with a section, a problem field and timer metrics that no schema names."""
    rows = spread(tables.reports(spark, sf_dir))
    timers = F.transform("timers", lambda t, i: F.struct(
        t["name"].alias("name"), t["duration"].alias("duration"), (F.col("problem.task-size") + i).alias("mem-alloc")
    ))
    content = F.to_json(F.struct(
        F.struct("problem.*", F.concat(F.lit("q"), F.col("problem.cpu")).alias("queue")).alias("problem"),
        "result",
        "git",
        timers.alias("timers"),
        F.struct(F.col("system.hostname").alias("node"), F.array("problem.cpu", F.lit(7)).alias("load.avg")).alias("environment"),
    ))
    return rows.select("_id", content.alias("content"))


@query(
    "lossless_intake",
    f"""WITH {REPORTS} SELECT id AS _id, duration, hostname AS node, cpu AS load, 'q' || cpu AS queue, 3 * size * 100 + 3 AS allocated FROM reports""",
)
def lossless_intake(spark, sf_dir):
    rows = report_sources.parse_reports(full_texts(spark, sf_dir))
    metrics = F.transform("timers", lambda t: member(t["rest"], "mem-alloc", "long"))
    environment = member(F.col("rest"), "environment")
    return rows.select(
        "_id",
        "result.duration",
        member(environment, "node", "string").alias("node"),
        F.try_variant_get(member(environment, "load.avg"), "$[0]", "int").alias("load"),
        member(F.col("problem.rest"), "queue", "string").alias("queue"),
        F.aggregate(metrics, F.lit(0).cast("long"), lambda a, b: a + b).alias("allocated"),
    )


@query(
    "saved_reports",
    f"""WITH {REPORTS} SELECT id::VARCHAR AS _id, dt::DATE AS day, duration, hostname AS node,
      CASE WHEN returncode = 1 THEN 2 ELSE 0 END::BIGINT AS logs, CASE WHEN returncode = 1 THEN strlen(test) + strlen(hostname) END::BIGINT AS bytes FROM reports""",
)
def saved_reports(spark, sf_dir):
    """Saved four times, in part, as a whole, and as a batch that is run again; read back with the logs."""
    rows = report_sources.parse_reports(full_texts(spark, sf_dir)).withColumn("run_id", F.col("_id").cast("string"))
    # Each save reads its reports and logs several times; they are parsed and joined once.
    rows = stored(rows, "parsed")
    files = rows.select("run_id", F.explode(F.array(
        F.struct(F.lit("job.log").alias("filename"), F.col("problem.test-name").cast("binary").alias("data")),
        F.struct(F.lit("node.log").alias("filename"), member(member(F.col("rest"), "environment"), "node", "string").cast("binary").alias("data")),
    )).alias("f")).select("run_id", "f.*")
    logs = stored(store.log_files(rows, files, "on-error"), "logs")
    names, root = store.TableNames.of("checks"), shared_folder(spark, "saved")
    some = F.col("run_id").cast("long") % 3 == 0
    store.save(rows.where(some), logs.where(some), names, root, "some")
    for batch in ("all", "all", None):
        store.save(rows, logs, names, root, batch)
    kept = store.saved_logs(spark, names, root).groupBy("run_id").agg(F.count(F.lit(1)).alias("logs"), F.sum("filesize").alias("bytes"))
    return store.saved_reports(spark, names, root).join(kept, "run_id", "left").select(
        "_id",
        F.col("day").cast("date").alias("day"),
        "result.duration",
        member(member(F.col("rest"), "environment"), "node", "string").alias("node"),
        F.coalesce("logs", F.lit(0)).cast("long").alias("logs"),
        "bytes",
    )


@query(
    "stored_view",
    f"""WITH {REPORTS}, v AS (SELECT hostname AS node, avg(duration) AS mean, count(*) AS items, id % 3 = 0 AS early FROM reports GROUP BY ALL)
    SELECT 'first' AS served, node, round(mean, 8) AS mean, items FROM v WHERE early
    UNION ALL SELECT 'again', node, round(mean, 8), items FROM v WHERE early
    UNION ALL SELECT 'fresh', hostname, round(avg(duration), 8), count(*) FROM reports GROUP BY hostname""",
)
def stored_view(spark, sf_dir):
    """A view is served from its store until reports are saved, and then built anew."""
    rows = stored(report_sources.parse_reports(full_texts(spark, sf_dir)).withColumn("_id", F.col("_id").cast("string")), "parsed")
    names, root = store.TableNames.of("views"), shared_folder(spark, "views")
    results = store.ResultStore(spark, f"{root}/results")

    def view():
        node = member(member(F.col("rest"), "environment"), "node", "string").alias("node")
        found = store.saved_reports(spark, names, root).groupBy(node)
        return found.agg(F.round(F.avg("result.duration"), 8).alias("mean"), F.count(F.lit(1)).alias("items"))

    def served(name):
        kept = results.get("views", {"per": "node"}, view, store.version(spark, names, root))
        return kept.select(F.lit(name).alias("served"), "node", "mean", "items")

    store.save(rows.where(F.col("_id").cast("long") % 3 == 0), None, names, root, "early")
    early = served("first").union(served("again"))
    store.save(rows, None, names, root, "all")
    return early.union(served("fresh"))


@query(
    "collection_audit",
    """SELECT event_type || '.json' AS file, count(*) AS items FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events""",
)
def collection_audit(spark, sf_dir):
    path = F.concat(F.lit("/runs/"), "user_id", F.lit("/"), "event_type", F.lit(".json"))
    return report_sources.collection_audit(tables.table(spark, sf_dir, "events").select(path.alias("source_path")))


@query(
    "sidecar_join",
    f"""WITH {REPORTS} SELECT id AS _id, CASE WHEN returncode = 1 THEN 9 ELSE 0 END AS returncode,
      CASE WHEN returncode = 1 THEN 0.5 ELSE duration END AS duration, CASE WHEN returncode = 1 THEN 'side-' || test ELSE test END AS test FROM reports""",
)
def sidecar_join(spark, sf_dir):
    rows = tables.reports(spark, sf_dir).withColumn(
        "source_path", F.concat(F.lit("/runs/"), "_id", F.lit("/report.json"))
    )
    side = rows.where("result.returncode = 1").select(
        report_sources.directory(F.col("source_path")).alias("run_dir"),
        F.lit(9).alias("returncode"),
        F.lit(0.5).alias("duration"),
        F.concat(F.lit("side-"), F.col("problem.test-name")).alias("test-name"),
        F.lit(None).cast("string").alias("case-name"),
    )
    joined = report_sources.with_sidecar(rows, side)
    return joined.select("_id", "result.returncode", "result.duration", F.col("problem.test-name").alias("test"))


@query(
    "log_files",
    """SELECT doc_id AS run_id, 'job_output.log' AS filename, strlen(text)::BIGINT AS filesize FROM documents WHERE n_chars % 2 <> 0""",
)
def log_files(spark, sf_dir):
    """Logs are kept for failed runs and for runs without a return code."""
    documents = tables.table(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") % 2 == 0, 0).when(F.col("n_chars") % 4 == 1, 1)
    runs = documents.select(
        F.col("doc_id").alias("run_id"),
        F.struct(F.lit(None).cast("int").alias("returncode")).alias("problem"),
        F.struct(code.alias("returncode")).alias("result"),
    )
    files = documents.select(
        F.col("doc_id").alias("run_id"), F.lit("job_output.log").alias("filename"), F.col("text").cast("binary").alias("data")
    )
    return store.log_files(runs, files, "on-error").select("run_id", "filename", "filesize")


@query(
    "commit_log",
    f"""WITH {COMMITS} SELECT commit AS hash, commit[1:7] AS short_hash, author, epoch(date)::BIGINT AS timestamp,
      strftime(date, '%Y_%m_%d-%H_%M_%S') AS fs_date, 2 AS refs, 'fix | the ' || branch || ' case' AS message FROM commits""",
)
def commit_log(spark, sf_dir):
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("date"))
    line = F.concat_ws(
        "|", "commit", F.substr("commit", F.lit(1), F.lit(7)), "author", F.lit("a@b.c"), F.lit("2 days ago"), seconds,
        F.concat(F.lit("HEAD -> "), "branch", F.lit(", origin/master")), F.concat(F.lit("fix | the "), "branch", F.lit(" case")),
    )
    rows = commit_sources.parse_log_lines(tables.commits(spark, sf_dir).select(line.alias("value")))
    return rows.select("hash", "short_hash", "author", "timestamp", "fs_date", F.size("refs").alias("refs"), "message")


@query(
    "push_triggers",
    f"""WITH {COMMITS} SELECT 'project-' || branch AS project, commit, CASE branch WHEN 'F' THEN 'master' ELSE 'release-' || branch END AS branch,
      'https://example.org/' || position AS url FROM commits WHERE branch <> 'P'""",
)
def push_triggers(spark, sf_dir):
    ref = F.expr("case branch when 'F' then 'refs/heads/master' when 'O' then 'refs/heads/release-O' else 'refs/heads/wip' end")
    payload = F.to_json(F.struct(
        ref.alias("ref"),
        F.col("commit").alias("after"),
        F.lit("not a list").alias("commits"),
        F.struct(
            F.concat(F.lit("project-"), "branch").alias("name"),
            F.concat(F.lit("https://example.org/"), "position").alias("html_url"),
        ).alias("repository"),
    ))
    events = commit_sources.parse_push_events(tables.commits(spark, sf_dir).select(payload.alias("payload")))
    return commit_sources.push_triggers(events, ["master", "release*"])


@query(
    "measure_seconds",
    """SELECT event_id AS _id, round(floor(value * 1000) / 1000, 6) AS seconds FROM events""",
)
def measure_seconds(spark, sf_dir):
    raw = F.concat(F.floor(F.col("value") * 1000).cast("string"), F.lit("\n"))
    seconds = report_sources.measure_seconds(raw)
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.round(seconds, 6).alias("seconds"))
