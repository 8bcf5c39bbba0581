"""Queries over nested reports and profiler trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import REPORTS, TIMERS, WALLTIMES, query
from runledger.functions.dates import epoch_seconds, parse_stamp, quarter_day
from runledger.functions.text import normalise_tag, series_title, template_part
from runledger.operators import reshape, tree
from runledger.sizing import spread
from runledger.sources import reports as report_sources
from runledger.sources import store, tables

TREE_JSON = """
concat('{"program-version": "2.', l_linenumber, '", "task-size": "', l_partkey, '", "run-process-count": "', l_linenumber,
  '", "children": [{"tag": "Whole Program", "file-path": "main.cc", "function": "main", "file-line": "', l_linenumber,
  '", "cumul-time-sum": "', l_quantity, '", "cumul-time-min": "', l_discount, '", "cumul-time-max": "', l_tax,
  '", "call-count-sum": "1", "children": [{"tag": "MyMesh::read_', l_returnflag, 'Data", "cumul-time-sum": "', l_tax,
  '", "children": [{"tag": "Node sort [x]", "cumul-time-sum": "', l_discount, '"}]}, {"tag": "Solve__', l_linestatus,
  '", "cumul-time-sum": "', l_extendedprice, '"}]}]}')
"""
TREES_SQL = """
lines AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS run, * FROM lineitem),
nodes AS (
  SELECT run, '0' AS place, '' AS parent, 'whole-program' AS tag, l_quantity AS seconds FROM lines
  UNION ALL
  SELECT run, '0.0', '/whole-program', 'my-mesh-read-' || lower(l_returnflag) || 'data', l_tax FROM lines
  UNION ALL
  SELECT run, '0.0.0', '/whole-program/my-mesh-read-' || lower(l_returnflag) || 'data', 'node-sort-[x]', l_discount FROM lines
  UNION ALL
  SELECT run, '0.1', '/whole-program', 'solve-' || lower(l_linestatus), l_extendedprice FROM lines)
"""


def trees(spark, sf_dir):
    lines = spread(tables.table(spark, sf_dir, "lineitem"))
    run = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run")
    return lines.select(run, F.expr(TREE_JSON).alias("json"))


@query(
    "flatten_report",
    f"""WITH {REPORTS}
    SELECT id AS _id, started, hostname AS "system.hostname", test AS "problem.test-name", kase AS "problem.case-name",
           cpu AS "problem.cpu", cpu || '_' || size || '_el' AS "problem.mesh", size::BIGINT * 100 AS "problem.task-size",
           weak AS "problem.weak", duration AS "result.duration", returncode AS "result.returncode",
           branch AS "git.branch", commit AS "git.commit", dt AS "git.datetime", 'reps-' || size AS "git.tag"
    FROM reports""",
)
def flatten_report(spark, sf_dir):
    return reshape.flatten(tables.reports(spark, sf_dir).drop("timers", "libs"))


@query(
    "unwind_timers",
    f"""WITH {TIMERS} SELECT id AS _id, test, name, path, round(seconds, 8) AS duration FROM timers""",
)
def unwind_timers(spark, sf_dir):
    rows = reshape.unwind(tables.reports(spark, sf_dir))
    return rows.select(
        "_id", F.col("problem.test-name").alias("test"), "timer.name", "timer.path", F.round("timer.duration", 8).alias("duration")
    )


@query(
    "derived_fields",
    f"""WITH {REPORTS} SELECT id AS _id, test, size, (size * 100 / cpu)::INT - ((size * 100 / cpu)::INT > size * 100 / cpu)::INT AS per_cpu, scale
    FROM reports""",
)
def derived_fields(spark, sf_dir):
    rows = tables.MAPPING.apply(tables.reports(spark, sf_dir), keep=("_id",))
    return rows.select(
        "_id",
        F.col("`problem.test`").alias("test"),
        F.col("`problem.size`").alias("size"),
        F.col("`problem.per.cpu`").alias("per_cpu"),
        F.col("`problem.scale`").alias("scale"),
    )


@query(
    "cast_by_pattern",
    f"""WITH {REPORTS} SELECT id AS _id, duration AS wall_total, size AS num_iter, cpu AS num_cpus, round(duration * 0.25, 8) AS wall_avg,
    try_cast(test AS DOUBLE) AS wall_bad FROM reports""",
)
def cast_by_pattern(spark, sf_dir):
    texts = tables.reports(spark, sf_dir).select(
        "_id",
        F.struct(
            F.col("result.duration").cast("string").alias("wall_total"),
            F.split("problem.mesh", "_")[1].alias("num_iter"),
            F.col("problem.test-name").alias("wall_bad"),
        ).alias("run"),
        F.col("problem.cpu").cast("string").alias("num_cpus"),
        F.array(F.struct((F.col("result.duration") * 0.25).cast("string").alias("wall_avg"))).alias("frames"),
    )
    rows = reshape.cast_by_pattern(texts, {"wall_.+": "double", "num_iter": "int", "num_cpus": "int"})
    return rows.select(
        "_id", "run.wall_total", "run.num_iter", "num_cpus", F.round(F.col("frames")[0]["wall_avg"], 8).alias("wall_avg"), "run.wall_bad"
    )


@query(
    "merge_reports",
    f"""WITH {REPORTS}
    SELECT id AS _id, CASE WHEN returncode = 1 THEN -1.0 ELSE duration END AS duration, returncode,
           commit, CASE WHEN returncode = 1 THEN '9.' || cpu END AS version, CASE WHEN returncode = 1 THEN 4 ELSE 3 END AS timers,
           CASE WHEN returncode = 1 THEN 'abort' ELSE 'solve' END AS last_timer
    FROM reports""",
)
def merge_reports(spark, sf_dir):
    base = tables.reports(spark, sf_dir)
    update = base.where("result.returncode = 1").select(
        "_id",
        F.struct(F.lit(-1.0).alias("duration")).alias("result"),
        F.struct(F.concat(F.lit("9."), F.col("problem.cpu")).alias("version")).alias("git"),
        F.array(
            F.struct(F.lit("abort").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(0.0).alias("duration"))
        ).alias("timers"),
    )
    merged = reshape.merge_reports(base, update, "_id")
    return merged.select(
        "_id",
        "result.duration",
        "result.returncode",
        "git.commit",
        "git.version",
        F.size("timers").alias("timers"),
        F.element_at("timers", -1)["name"].alias("last_timer"),
    )


@query(
    "head_tail_split",
    f"""WITH {REPORTS} SELECT id AS _id, '1.' || (u % 7) AS version, 1 AS libs, 'io' AS first_lib FROM reports""",
)
def head_tail_split(spark, sf_dir):
    rows = reshape.head_and_tail(tables.reports(spark, sf_dir), "libs", "version", "version")
    return rows.select("_id", "version", F.size("libs").alias("libs"), F.col("libs")[0]["name"].alias("first_lib"))


@query(
    "one_report_per_timer",
    f"""WITH {TIMERS} SELECT sha256(id::VARCHAR) AS run_id, name AS frame, test, round(seconds, 8) AS duration FROM timers""",
)
def one_report_per_timer(spark, sf_dir):
    rows = reshape.one_report_per_timer(tables.reports(spark, sf_dir), "_id")
    return rows.select("run_id", "frame", F.col("problem.test-name").alias("test"), F.round("result.duration", 8).alias("duration"))


@query(
    "normalise_tag",
    """SELECT DISTINCT tag, regexp_replace(lower(replace(replace(regexp_replace(tag, '([a-z])([A-Z])', '\\1-\\2', 'g'), '::', '-'), ' ', '-')),
       '[_-]+', '-', 'g') AS name FROM (SELECT 'My' || p_type || '::' || p_name || '_solveStep  x' AS tag FROM part)""",
)
def normalise(spark, sf_dir):
    tag = F.concat(F.lit("My"), "p_type", F.lit("::"), "p_name", F.lit("_solveStep  x"))
    rows = tables.table(spark, sf_dir, "part").select(tag.alias("tag")).distinct()
    return rows.select("tag", normalise_tag(F.col("tag")).alias("name"))


@query(
    "tree_paths",
    f"""WITH {TREES_SQL} SELECT run, place, parent || '/' || tag AS path, parent, tag FROM nodes""",
)
def tree_paths(spark, sf_dir):
    rows = tree.tree_rows(trees(spark, sf_dir), "run", "json", node=False)
    return rows.select("run", F.array_join("pos", ".").alias("place"), "path", "parent", "tag")


@query(
    "profiler_report",
    f"""WITH {TREES_SQL}
    SELECT run, '2.' || l_linenumber AS version, l_partkey AS task_size, l_linenumber::DOUBLE AS cpus, 'whole-program' AS name,
      round(l_quantity / l_linenumber, 8) AS duration, round(1.0 / l_linenumber, 8) AS executed, 'main.cc' AS file_path, l_linenumber AS line,
      CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 8) END AS dur_ratio,
      replace('/whole-program,/whole-program/X,/whole-program/X/node-sort-[x],/whole-program/solve-', 'X', 'my-mesh-read-' || lower(l_returnflag) || 'data')
        || lower(l_linestatus) AS paths,
      round(l_quantity + l_tax + l_discount + l_extendedprice, 6) AS timed, 0 AS returncode FROM lines""",
)
def profiler_report(spark, sf_dir):
    """Profiles as whole reports, with the status file of their folder."""
    path = F.concat(F.lit("/runs/"), "run", F.lit("/profile.json"))
    documents = trees(spark, sf_dir).select("run", path.alias("source_path"), F.col("json").alias("content"))
    rows = report_sources.collect(documents, "profiler-report")
    rows = rows.withColumn("result", F.col("result").withField("returncode", F.lit(0)))
    timed = F.aggregate("timers", F.lit(0.0), lambda total, t: total + t["duration"])
    return rows.select(
        "run",
        "git.version",
        F.col("problem.task-size").alias("task_size"),
        "problem.cpus",
        "result.name",
        F.round("result.duration", 8).alias("duration"),
        F.round("result.executed", 8).alias("executed"),
        F.col("result.file-path").alias("file_path"),
        F.col("result.file-line").alias("line"),
        F.round("result.dur-ratio", 8).alias("dur_ratio"),
        F.array_join("timers.path", ",").alias("paths"),
        F.round(timed, 6).alias("timed"),
        "result.returncode",
    )


@query(
    "path_hash",
    f"""WITH {TREES_SQL} SELECT DISTINCT parent || '/' || tag AS path, md5(tag) AS tag_hash, md5(parent || '/' || tag) AS path_hash,
       md5(parent) AS parent_hash FROM nodes""",
)
def path_hash(spark, sf_dir):
    rows = tree.path_digests(tree.tree_rows(trees(spark, sf_dir), "run", "json", node=False).select("path", "parent", "tag"))
    return rows.select("path", "tag_hash", "path_hash", "parent_hash").distinct()


@query(
    "metric_ratio",
    """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS run,
       round(l_quantity / l_linenumber, 8) AS duration, round(1.0 / l_linenumber, 8) AS executed,
       'main.cc' AS file_path, l_linenumber AS line,
       CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 8) END AS dur_ratio FROM lineitem""",
)
def metric_ratio(spark, sf_dir):
    documents = trees(spark, sf_dir).select(
        "run",
        F.expr("parse_json(json)").alias("document"),
    )
    roots = documents.select(
        "run",
        F.expr("variant_get(document, '$.children[0]', 'variant')").alias("node"),
        F.expr("variant_get(document, '$.run-process-count', 'string')").alias("processes"),
    )
    rows = roots.select("run", *tree.node_metrics("node", F.col("processes")))
    return rows.select(
        "run",
        F.round("duration", 8).alias("duration"),
        F.round("executed", 8).alias("executed"),
        F.col("file-path").alias("file_path"),
        F.col("file-line").alias("line"),
        F.round("dur-ratio", 8).alias("dur_ratio"),
    )


@query(
    "parse_run_dir",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN replace(p_name, '.', '') ELSE p_name END AS name,
       CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE p_size END AS cpus,
       CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_size END ELSE 0 END::BIGINT AS size
       FROM part""",
)
def parse_run_dir(spark, sf_dir):
    element = "if(p_size % 2 = 0, concat('1_', p_partkey, '_el'), cast(p_size as string))"
    name = F.expr(
        f"""case p_partkey % 3 when 0 then concat(p_name, '.', p_size, '.', {element})
            when 1 then concat(p_name, '.', p_size) else p_name end"""
    )
    rows = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tree.run_from_directory(name).alias("r"))
    return rows.select("id", "r.*")


@query(
    "index_key",
    f"""WITH {REPORTS} SELECT id AS _id, commit, cpu::BIGINT AS mesh_cpus, size::BIGINT AS mesh_size, 0::BIGINT AS bad_part, 0::BIGINT AS missing,
       test AS benchmark, size::DOUBLE AS size_f, false AS flag FROM reports""",
)
def index_key(spark, sf_dir):
    mesh = F.col("problem.mesh")
    return tables.reports(spark, sf_dir).select(
        "_id",
        "git.commit",
        template_part(mesh, 0, "i").alias("mesh_cpus"),
        template_part(mesh, 1, "i").alias("mesh_size"),
        template_part(mesh, 2, "i").alias("bad_part"),
        template_part(mesh, 3, "i").alias("missing"),
        template_part(F.col("problem.test-name"), None, "s").alias("benchmark"),
        template_part(mesh, 1, "f").alias("size_f"),
        template_part(mesh, 2, "b").alias("flag"),
    )


@query(
    "parse_stamp",
    f"""WITH {REPORTS} SELECT id AS _id, epoch(date_trunc('second', started))::BIGINT AS seconds FROM reports""",
)
def parse_stamps(spark, sf_dir):
    stamp = F.date_format("started", "MM/dd/yy HH:mm:ss")
    return tables.reports(spark, sf_dir).select("_id", parse_stamp(stamp).alias("seconds"))


@query(
    "unpivot_frames",
    f"""WITH {WALLTIMES} SELECT tag, excl, frame, round(walltime, 8) AS walltime FROM (
       SELECT tag, excl, 'walltime' AS frame, walltime FROM walltimes
       UNION ALL SELECT tag, excl, 'walltime_mem_l1', walltime_mem_l1 FROM walltimes
       UNION ALL SELECT tag, excl, 'walltime_mem_l2', walltime_mem_l2 FROM walltimes
       UNION ALL SELECT tag, excl, 'walltime_mem_l3', walltime_mem_l3 FROM walltimes)""",
)
def unpivot_frames(spark, sf_dir):
    values = ["walltime", "walltime_mem_l1", "walltime_mem_l2", "walltime_mem_l3"]
    rows = tables.walltimes(spark, sf_dir).withColumn("total", F.col("walltime")).drop("walltime").withColumnRenamed("total", "walltime")
    long = reshape.wide_to_long(rows, ["tag", "excl"], values, "frame", "seconds")
    return long.select("tag", "excl", "frame", F.round("seconds", 8).alias("walltime"))


@query(
    "pivot_timers",
    f"""WITH {REPORTS} SELECT id AS _id, duration AS "walltime_whole-program", size / 100.0::DOUBLE AS walltime_solve,
       CASE WHEN u % 3 = 0 THEN round(duration * 0.25, 8) END AS "walltime_assembly-0" FROM reports""",
)
def pivot_timers(spark, sf_dir):
    wide = reshape.timers_to_columns(tables.reports(spark, sf_dir), "_id", ["whole-program", "solve", "assembly-0"])
    return wide.withColumn("walltime_assembly-0", F.round(F.col("`walltime_assembly-0`"), 8))


@query(
    "tag_features",
    f"""WITH {REPORTS} SELECT id AS _id, commit[1:8] AS commit, size AS timepoint,
       CASE WHEN length('reps-' || size) = 7 THEN 'reps-0' || size ELSE 'reps-' || size END AS tag, split_part(hostname, '.', 1) AS hpc,
       split_part(hostname, '.', 1) = 'node2' AS excl, epoch(date_trunc('second', started))::BIGINT AS timestamp FROM reports""",
)
def tag_features(spark, sf_dir):
    tag = F.col("git.tag")
    host = F.substring_index("system.hostname", ".", 1)
    padded = F.when(F.length(tag) == 7, F.concat(F.substr(tag, F.lit(1), F.lit(5)), F.lit("0"), F.substr(tag, F.lit(6)))).otherwise(tag)
    return tables.reports(spark, sf_dir).select(
        "_id",
        F.substr("git.commit", F.lit(1), F.lit(8)).alias("commit"),
        F.split(tag, "-")[1].try_cast("int").alias("timepoint"),
        padded.alias("tag"),
        host.alias("hpc"),
        (host == "node2").alias("excl"),
        epoch_seconds(F.col("started")).alias("timestamp"),
    )


@query(
    "quarter_day",
    f"""WITH {REPORTS}, q AS (SELECT started, (hour(started) // 6)::INT AS q FROM reports)
       SELECT strftime(started, '%Y-%m-%d') || '-q' || (q + 1) || '(' || lpad((q * 6)::VARCHAR, 2, '0') || '-' ||
       lpad((q * 6 + 5)::VARCHAR, 2, '0') || ')h' AS quarter, count(*) AS items FROM q GROUP BY 1""",
)
def quarter_days(spark, sf_dir):
    label = quarter_day(F.col("started")).alias("quarter")
    return tables.reports(spark, sf_dir).groupBy(label).agg(F.count(F.lit(1)).alias("items"))


@query(
    "series_title",
    f"""WITH {REPORTS} SELECT DISTINCT 'test=' || test || ', cpu=' || cpu AS title FROM reports""",
)
def series_titles(spark, sf_dir):
    title = series_title(["test", "cpu"], [F.col("problem.test-name"), F.col("problem.cpu")])
    return tables.reports(spark, sf_dir).select(title.alias("title")).distinct()


@query(
    "nested_default",
    f"""WITH {TIMERS} SELECT id AS _id, name, coalesce(path, '?') AS path FROM timers""",
)
def nested_default(spark, sf_dir):
    rows = reshape.unwind(tables.reports(spark, sf_dir))
    return rows.select("_id", "timer.name", reshape.nested_value("timer.path", "?").alias("path"))


@query(
    "attach_constants",
    f"""WITH {REPORTS} SELECT id AS _id, cpu, 'test-full' AS stage, 'core' AS name FROM reports""",
)
def attach_constants(spark, sf_dir):
    rows = reshape.attach_constants(tables.reports(spark, sf_dir), "problem", {"stage": "test-full"})
    rows = reshape.attach_constants(rows, "git", {"name": "core"})
    return rows.select("_id", "problem.cpu", "problem.stage", "git.name")


@query(
    "find_and_flatten",
    f"""WITH {REPORTS} SELECT id AS _id, duration AS "result.duration", returncode AS "result.returncode", cpu AS cpu
    FROM reports WHERE commit = md5('2024-01-10')""",
)
def find_and_flatten(spark, sf_dir):
    match = F.col("git.commit") == F.md5(F.lit("2024-01-10"))
    return reshape.flatten(store.find(tables.reports(spark, sf_dir), match, ["_id", "result", "problem.cpu"]))
