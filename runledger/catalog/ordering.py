"""Queries that depend on an order: numbering, clusters, squeezing and commit selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import COMMITS, REPORTS, query
from runledger.functions.dates import epoch_seconds
from runledger.operators import aggregates, clusters, history
from runledger.operators.ordering import running_total
from runledger.sources import tables


def flat(spark, sf_dir):
    return tables.reports(spark, sf_dir).select(
        "_id",
        "started",
        F.col("problem.test-name").alias("test"),
        F.col("problem.cpu").alias("cpu"),
        F.col("result.duration").alias("duration"),
        F.col("git.datetime").alias("dt"),
        (F.col("system.hostname").startswith("node2")).alias("excl"),
    )


@query(
    "squeeze_groups",
    f"""WITH {REPORTS}, xs AS (SELECT DISTINCT test, dt FROM reports),
    g AS (SELECT test, dt, ((row_number() OVER (PARTITION BY test ORDER BY dt) - 1) // 4)::BIGINT AS no FROM xs),
    spans AS (SELECT test, no, min(dt) AS b, max(dt) AS e, count(*) AS n FROM g GROUP BY 1, 2),
    labels AS (SELECT test, no, n, CASE WHEN b = e THEN 'group ' || chr((65 + no)::INT) || ' (1 item, ' || strftime(b, '%Y-%m-%d %H:%M:%S') || ')'
      ELSE 'group ' || chr((65 + no)::INT) || ' (' || n || ' items, period of ' || date_diff('day', b, e) || ' day' ||
           CASE WHEN date_diff('day', b, e) > 1 THEN 's' ELSE '' END || ')' END AS label FROM spans)
    SELECT r.test, label AS "group", g.no AS group_no, count(*) AS items, round(avg(duration), 8) AS mean
    FROM reports r JOIN g USING (test, dt) JOIN labels l ON l.test = r.test AND l.no = g.no GROUP BY ALL""",
)
def squeeze_groups(spark, sf_dir):
    rows = aggregates.squeeze(flat(spark, sf_dir), ["test"], "dt", 4)
    return rows.groupBy("test", F.col("squeeze_label").alias("group"), F.col("squeeze_no").alias("group_no")).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("duration"), 8).alias("mean")
    )


@query(
    "squeeze_text_axis",
    f"""WITH {REPORTS}, xs AS (SELECT DISTINCT test, cpu::VARCHAR AS x FROM reports),
    g AS (SELECT test, x, ((row_number() OVER (PARTITION BY test ORDER BY x) - 1) // 3)::BIGINT AS no FROM xs),
    spans AS (SELECT test, no, min(x) AS b, max(x) AS e, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT test, no AS group_no, CASE WHEN b = e THEN 'group ' || chr((65 + no)::INT) || ' (1 item, ' || b || ')'
      ELSE 'group ' || chr((65 + no)::INT) || ' (' || n || ' items, ' || b || ' - ' || e || ')' END AS "group" FROM spans""",
)
def squeeze_text_axis(spark, sf_dir):
    rows = flat(spark, sf_dir).withColumn("x", F.col("cpu").cast("string"))
    squeezed = aggregates.squeeze(rows, ["test"], "x", 3)
    return squeezed.select("test", F.col("squeeze_no").alias("group_no"), F.col("squeeze_label").alias("group")).distinct()


REPETITION_SQL = f"""WITH {REPORTS} SELECT id AS _id, test, row_number() OVER (PARTITION BY test ORDER BY started, id) - 1 AS no FROM reports"""


@query("repetition_no", REPETITION_SQL)
def repetition_no(spark, sf_dir):
    rows = running_total(flat(spark, sf_dir), ["test"], [F.col("started"), F.col("_id")])
    return rows.select("_id", "test", (F.col("row_no") - 1).alias("no"))


@query("repetition_no_spread", REPETITION_SQL)
def repetition_no_spread(spark, sf_dir):
    """Kept under its earlier name: there is one plan for every size now."""
    rows = running_total(flat(spark, sf_dir), ["test"], [F.col("started"), F.col("_id")])
    return rows.select("_id", "test", (F.col("row_no") - 1).alias("no"))


@query(
    "sample_per_group",
    f"""WITH {REPORTS} SELECT id AS _id, test, duration FROM reports
    QUALIFY row_number() OVER (PARTITION BY test ORDER BY md5(id || '/1234'), id) <= 5""",
)
def sample_per_group(spark, sf_dir):
    return history.sample_per_group(flat(spark, sf_dir), ["test"], 5, "_id").select("_id", "test", "duration")


PER_DAY_SQL = f"""WITH {COMMITS}, marked AS (SELECT *, lag(date::DATE) OVER (PARTITION BY branch ORDER BY position DESC) AS before FROM commits)
    SELECT branch, position, commit, date FROM marked WHERE before IS DISTINCT FROM date::DATE"""


@query("commit_per_day", PER_DAY_SQL)
def commit_per_day(spark, sf_dir):
    return picked(spark, sf_dir)


@query("commit_per_day_spread", PER_DAY_SQL)
def commit_per_day_spread(spark, sf_dir):
    """Kept under its earlier name: there is one plan for every size now."""
    return picked(spark, sf_dir)


def picked(spark, sf_dir):
    rows = tables.commits(spark, sf_dir).withColumn("day", F.to_date("date"))
    chosen = history.pick_commits(rows, ["branch"], [F.desc("position")], "day", "commit-per-day")
    return chosen.select("branch", "position", "commit", "date")


@query(
    "latest_per_branch",
    f"""WITH {COMMITS} SELECT branch, commit, date FROM commits
    QUALIFY row_number() OVER (PARTITION BY branch ORDER BY date DESC, commit) <= 10""",
)
def latest_per_branch(spark, sf_dir):
    rows = history.latest_per_branch(tables.commits(spark, sf_dir), "branch", [F.desc("date"), F.col("commit")], 10)
    return rows.select("branch", "commit", "date")


@query("latest_commits", f"""WITH {COMMITS} SELECT commit, date FROM commits ORDER BY date DESC, commit LIMIT 50""")
def latest_commits(spark, sf_dir):
    rows = history.latest_commits(tables.commits(spark, sf_dir), [F.desc("date"), F.col("commit")], 50)
    return rows.select("commit", "date")


@query(
    "unique_commits",
    f"""WITH {COMMITS}, seen AS (SELECT author AS commit, branch, date FROM commits)
    SELECT commit, max(date) AS date, min(branch) AS branch, count(*) AS seen FROM seen GROUP BY 1""",
)
def unique_commits(spark, sf_dir):
    rows = tables.commits(spark, sf_dir).select(F.col("author").alias("commit"), "branch", "date")
    return history.unique_commits(rows, "commit", "branch", "date")


# A cluster starts at the first time more than the spacing after the start before it.
CLUSTER_SQL = f"""WITH RECURSIVE {REPORTS},
    points AS (SELECT DISTINCT test, hostname LIKE 'node2%' AS excl, epoch(date_trunc('second', started))::BIGINT AS t,
               CASE WHEN hostname LIKE 'node2%' THEN 86400 ELSE 3600 END AS gap FROM reports),
    starts AS (SELECT test, excl, gap, min(t) AS t, 0::BIGINT AS cluster FROM points GROUP BY ALL
      UNION ALL SELECT s.test, s.excl, s.gap, n.t, s.cluster + 1 FROM starts s, LATERAL (
        SELECT min(p.t) AS t FROM points p WHERE p.test = s.test AND p.excl = s.excl AND p.t > s.t + s.gap) n WHERE n.t IS NOT NULL),
    owned AS (SELECT p.test, p.excl, p.t, max(s.cluster) AS cluster FROM points p JOIN starts s
      ON s.test = p.test AND s.excl = p.excl AND s.t <= p.t GROUP BY ALL)"""
CLUSTER_ROWS_SQL = f"""{CLUSTER_SQL}
    SELECT r.id AS _id, r.test, o.excl, o.cluster FROM reports r JOIN owned o ON o.test = r.test
      AND o.excl = (r.hostname LIKE 'node2%') AND o.t = epoch(date_trunc('second', r.started))::BIGINT"""


def clustered(spark, sf_dir):
    rows = flat(spark, sf_dir).withColumns({
        "t": epoch_seconds(F.col("started")),
        "gap": F.when(F.col("excl"), 24 * 3600).otherwise(3600),
    })
    return clusters.anchored_clusters(rows, ["test", "excl"], "t", "gap")


@query("anchored_clusters", CLUSTER_ROWS_SQL)
def anchored_clusters(spark, sf_dir):
    return clustered(spark, sf_dir).select("_id", "test", "excl", "cluster")


@query("anchored_clusters_spread", CLUSTER_ROWS_SQL)
def anchored_clusters_spread(spark, sf_dir):
    """Kept under its earlier name: there is one plan for every size now."""
    return clustered(spark, sf_dir).select("_id", "test", "excl", "cluster")


@query(
    "cluster_labels",
    f"""{CLUSTER_SQL}
    SELECT r.test, o.excl, o.cluster, strftime(min(started), '%Y-%m-%d') || ' (' || strftime(min(started), '%H:%M') || ' - ' ||
      strftime(max(started), '%H:%M') || ')' AS label, count(*) AS items
    FROM reports r JOIN owned o ON o.test = r.test AND o.excl = (r.hostname LIKE 'node2%') AND o.t = epoch(date_trunc('second', r.started))::BIGINT
    GROUP BY ALL""",
)
def cluster_labels(spark, sf_dir):
    return clusters.cluster_labels(clustered(spark, sf_dir), ["test", "excl"], "started")
