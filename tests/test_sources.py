import json
import os

import pytest
from pyspark.sql import functions as F

from runledger.operators.filters import branch_matches
from runledger.sources import commits, reports, store
from runledger.sources.schema import PUSH
from runledger.streaming import intake

REPORT = {
    "problem": {"application": "stencil"},
    "result": {"duration": 8.25},
    "timers": [{"duration": 3.0, "name": "load"}, {"duration": 5.25, "name": "solve"}],
    "git": {"commit": "c1", "datetime": "2024-01-02T03:04:05"},
}


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))


def test_json_reports_and_rejects(spark, tmp_path):
    write(tmp_path / "a" / "one.json", REPORT)
    write(tmp_path / "b" / "c" / "two.json", {**REPORT, "result": {"duration": 2.0}})
    write(tmp_path / "b" / "bad.json", json.dumps(REPORT)[:-20])
    write(tmp_path / "b" / "note.txt", "x")
    rows = reports.read_json_reports(spark, str(tmp_path))
    assert sorted(r["result"]["duration"] for r in rows.collect()) == [2.0, 8.25]
    rejected = reports.read_json_rejects(spark, str(tmp_path)).collect()
    assert [r["source_path"].rsplit("/", 1)[1] for r in rejected] == ["bad.json"]
    assert reports.collect(rows, "generic").count() == 2
    with pytest.raises(KeyError):
        reports.collect(rows, "none")
    audit = {r["file"]: r["items"] for r in reports.collection_audit(rows).collect()}
    assert audit == {"one.json": 1, "two.json": 1, None: 2}


def test_yaml_reports(spark, tmp_path):
    write(tmp_path / "r.yaml", "result:\n  duration: 3.5\ntimers:\n- {name: a, duration: 1}\n")
    write(tmp_path / "bad.yaml", "a: [1\nb: }")
    rows = reports.parse_reports(reports.read_texts(spark, str(tmp_path), "*.yaml"), kind="yaml").collect()
    assert [(r["result"]["duration"], r["timers"][0]["name"]) for r in rows] == [(3.5, "a")]
    texts = reports.read_texts(spark, str(tmp_path))
    assert reports.parse_reports(texts, kind="raw").count() == 2


@pytest.mark.parametrize(
    ("output", "want"),
    [
        ("", []),
        ("no marker", []),
        ("x [S] {1} [E] y", ["{1}"]),
        ("[S]\n a \n[E] mid [S]b[E]", ["a", "b"]),
        ("[S] a [E] [S] open", ["a"]),
    ],
)
def test_cut_reports(spark, output, want):
    df = spark.createDataFrame([(1, output)], "run int, output string")
    rows = reports.cut_reports(df, "output", "[S]", "[E]").orderBy("name").collect()
    assert [r["content"] for r in rows] == want
    assert [r["name"] for r in rows] == [f"parse-result-{i + 1:02d}" for i in range(len(want))]


def test_sidecar_from_files(spark, tmp_path):
    write(tmp_path / "run1" / "profile.json", REPORT)
    write(tmp_path / "run1" / "runtest.status.json", {"returncode": 3, "duration": 9.5, "test-name": "t1"})
    write(tmp_path / "run2" / "profile.json", {"timers": []})
    rows = reports.read_json_reports(spark, str(tmp_path), "profile.json")
    joined = reports.with_sidecar(rows, reports.read_sidecars(spark, str(tmp_path)))
    got = {reports_dir(r): (r["result"]["returncode"], r["result"]["duration"], r["problem"]["test-name"]) for r in joined.collect()}
    assert got == {"run1": (3, 9.5, "t1"), "run2": (None, None, None)}


def reports_dir(row):
    return row["source_path"].split("/")[-2]


def test_measures(spark, tmp_path):
    write(tmp_path / "x.artifact.json", {"duration": 1.25, "container-duration": 2.0})
    assert reports.read_measures(spark, str(tmp_path)).first()["duration"] == 1.25
    assert spark.range(1).select(reports.measure_seconds(F.lit("1250 "))).first()[0] == 1.25


def test_frames_collector(spark):
    df = spark.createDataFrame(
        [([("solve", "1.5")], [("2019.1",), ("3.4",)], "10")],
        "frames array<struct<name:string, wall_avg:string>>, libs array<struct<version:string>>, size string",
    )
    row = reports.collect(df, "frames").first()
    assert row["timers"][0]["wall_avg"] == 1.5 and row["git"]["version"] == "2019.1"
    assert [x["version"] for x in row["libs"]] == ["3.4"] and row["size"] == 10


def test_profiler_collector(spark):
    body = {"program-version": "2.2", "task-size": "40", "run-process-count": "4",
            "children": [{"tag": "Whole Program", "cumul-time-sum": "8", "children": [{"tag": "A B", "cumul-time-sum": "2"}]}]}
    df = spark.createDataFrame([("p1", json.dumps(body))], "source_path string, content string")
    rows = reports.collect(df, "profiler").orderBy("pos").collect()
    assert [(r["name"], r["duration"], r["cpus"], r["task_size"]) for r in rows] == [("whole-program", 8.0, 4.0, 40), ("a-b", 2.0, 4.0, 40)]


@pytest.mark.parametrize(
    ("policy", "kept"), [("on-error", ["fail", "missing", "old-style"]), ("always", ["fail", "missing", "ok", "old-style"]), ("never", [])]
)
def test_log_policy(spark, policy, kept):
    schema = "run_id string, problem struct<returncode:int>, result struct<returncode:int>"
    runs = spark.createDataFrame([("ok", (None,), (0,)), ("fail", (None,), (2,)), ("missing", (None,), (None,)), ("old-style", (1,), (0,))], schema)
    files = spark.createDataFrame([(r, "job.log", bytearray(b"abc")) for r in ("ok", "fail", "missing", "old-style")], "run_id string, filename string, data binary")
    rows = store.log_files(runs, files, policy).orderBy("run_id").collect()
    assert [r["run_id"] for r in rows] == kept
    assert all(r["filesize"] == 3 and len(r["file_id"]) == 64 for r in rows)
    with pytest.raises(ValueError):
        store.keeps_logs("sometimes", F.lit(1))


def test_table_names_and_save(spark, tmp_path):
    assert store.TableNames.of(None).db_name == "default"
    names = store.TableNames.of("p", {"col_files_name": "logs"})
    assert (names.db_name, names.col_timers_name, names.col_files_name, names.col_history_name, names.col_running_name) == ("p", "timers", "logs", "hist", "running")
    write(tmp_path / "in" / "one.json", REPORT)
    rows = reports.read_json_reports(spark, str(tmp_path / "in")).withColumn("run_id", F.lit("r1"))
    files = spark.createDataFrame([("r1", "a.log", bytearray(b"x")), ("r1", "b.log", None)], "run_id string, filename string, data binary")
    logs = store.log_files(rows, files, "on-error")
    store.save(rows, logs, names, str(tmp_path / "db"))
    stored = spark.read.parquet(names.path(str(tmp_path / "db"), "timers"))
    assert stored.count() == 1 and str(stored.first()["day"]) == "2024-01-02"
    assert spark.read.parquet(names.path(str(tmp_path / "db"), "logs")).count() == 2
    assert store.find(stored, F.col("git.commit") == "c1", ["result.duration"]).first()[0] == 8.25
    assert store.find_one(stored).count() == 1


def saved(spark, names, root):
    return sorted((r["result"]["duration"], r["source_path"][-8:]) for r in store.saved_reports(spark, names, root).collect())


def test_saving_again_leaves_the_same_rows(spark, tmp_path):
    names, root = store.TableNames.of("p"), str(tmp_path / "db")
    assert store.saved_reports(spark, names, root) is None and store.saved_logs(spark, names, root) is None
    write(tmp_path / "in" / "one.json", REPORT)
    write(tmp_path / "in" / "two.json", {**REPORT, "result": {"duration": 2.0}, "git": {}})
    write(tmp_path / "in" / "six.json", {**REPORT, "_id": "known", "result": {"duration": 3.0}})
    rows = reports.read_json_reports(spark, str(tmp_path / "in")).withColumn("run_id", F.element_at(F.split("source_path", "/"), -1))
    rows = rows.withColumn("_id", F.try_variant_get("rest", "$._id", "string"))
    files = spark.createDataFrame([(f"{r}.json", n, bytearray(d)) for r in ("one", "two") for n, d in (("a.log", b"same"), ("b.log", r.encode()))], "run_id string, filename string, data binary")
    logs = store.log_files(rows, files, "on-error")
    want = [(2.0, "two.json"), (3.0, "six.json"), (8.25, "one.json")]
    store.save(rows.where("result.duration > 2"), logs.where("run_id = 'one.json'"), names, root)
    for batch in (None, None, "again", "again"):
        store.save(rows.union(rows), logs, names, root, batch)
        assert saved(spark, names, root) == want
        found = store.saved_logs(spark, names, root).collect()
        assert sorted((r["run_id"], r["filename"], bytes(r["data"])) for r in found) == sorted((r["run_id"], r["filename"], bytes(r["data"])) for r in files.collect())


def test_broken_save_is_not_seen_and_may_run_again(spark, tmp_path):
    names, root = store.TableNames.of("p"), str(tmp_path / "db")
    write(tmp_path / "in" / "one.json", REPORT)
    rows = reports.read_json_reports(spark, str(tmp_path / "in"))
    store.save(rows, None, names, root, "first")
    # A save that broke off before its commit: reports are there, its entry is not.
    other = rows.withColumn("source_path", F.lit("/runs/two.json"))
    store.report_ids(other).withColumn("day", F.to_date("git.datetime")).write.partitionBy("day").parquet(f"{root}/p/timers/batch=b-second")
    assert saved(spark, names, root) == [(8.25, "one.json")]
    store.save(other, None, names, root, "second")
    assert saved(spark, names, root) == [(8.25, "one.json"), (8.25, "two.json")]


def test_stream_saves_each_batch_once(spark, tmp_path):
    names, root = store.TableNames.of("p"), str(tmp_path / "db")
    for name in ("one", "two"):
        write(tmp_path / "in" / f"{name}.json", REPORT)
        stream = intake.report_stream(spark, str(tmp_path / "in"))
        intake.save_stream(stream, names, root, str(tmp_path / "cp")).awaitTermination(60)
    want = [(8.25, "one.json"), (8.25, "two.json")]
    assert saved(spark, names, root) == want
    # A new checkpoint replays both files, as one batch with a number already taken and as one of another name.
    for name in ("reports", "replayed"):
        stream = intake.report_stream(spark, str(tmp_path / "in"))
        intake.save_stream(stream, names, root, str(tmp_path / f"cp-{name}"), name).awaitTermination(60)
        assert saved(spark, names, root) == want


ODD_REPORT = {
    **REPORT,
    "environment": {"modules": ["gcc", "mpi"], "nested": {"a.b": 1}},
    "problem": {"application": "stencil", "cpu": "four", "depth": None, "extra": [1, 2]},
    "timers": [{"duration": 3.0, "name": "load", "mem-alloc": 7, "cnt": {"x": 1}}, "no timer", {"name": "solve"}],
    "libs": "none",
}


def put_together(value, rest):
    """A shredded row as the document it came from."""
    if isinstance(value, list):
        return [put_together(x, None) for x in value]
    if not isinstance(value, dict):
        return value
    own = {k: put_together(v, None) for k, v in value.items() if k != "rest" and v is not None}
    left = value.get("rest")
    return {**own, **left} if isinstance(left, dict) else own if left is None else left


def test_no_field_is_lost(spark, tmp_path):
    write(tmp_path / "a" / "odd.json", ODD_REPORT)
    write(tmp_path / "a" / "list.json", [REPORT, ODD_REPORT, 3])
    for kind, texts in (
        ("json", reports.read_texts(spark, str(tmp_path / "a"))),
        ("yaml", spark.createDataFrame([(json.dumps(d),) for d in (ODD_REPORT, REPORT, ODD_REPORT)], "content string")),
    ):
        rows = reports.parse_reports(texts, kind=kind)
        # Through a file, as the store keeps them.
        path = str(tmp_path / kind)
        rows.drop("source_path").write.parquet(path)
        # Variants come back as documents in JSON.
        back = [json.loads(r[0]) for r in spark.read.parquet(path).select(F.to_json(F.struct("*"))).collect()]
        got = sorted((json.dumps(put_together(d, None), sort_keys=True) for d in back), key=len)
        git = {"git": {"commit": "c1", "datetime": "2024-01-02T03:04:05.000"}}
        want = [json.dumps({**d, **git}, sort_keys=True) for d in (REPORT, ODD_REPORT, ODD_REPORT)]
        assert [json.loads(x) for x in got] == [json.loads(x) for x in want]
    typed = reports.parse_reports(reports.read_texts(spark, str(tmp_path / "a"), "odd.json")).first()
    assert typed["problem"]["application"] == "stencil" and typed["problem"]["cpu"] is None
    assert [t and t["duration"] for t in typed["timers"]] == [3.0, None, None] and typed["libs"] is None


def test_result_store_builds_once(spark, tmp_path):
    results, built = store.ResultStore(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.range(3)

    assert results.get("p", {"a": 1}, build).count() == results.get("p", {"a": 1}, build).count() == 3
    results.get("p", {"a": 2}, build)
    assert len(built) == 2


def test_result_store_is_fresh_after_a_save(spark, tmp_path):
    names, root, results = store.TableNames.of("p"), str(tmp_path / "db"), store.ResultStore(spark, str(tmp_path / "views"))
    count = lambda: results.get("p", {}, lambda: store.saved_reports(spark, names, root).groupBy().count(), store.version(spark, names, root)).first()[0]
    assert store.version(spark, names, root) == "0"
    seen = []
    for name in ("one", "two", "two"):
        write(tmp_path / "in" / f"{name}.json", REPORT)
        store.save(reports.read_json_reports(spark, str(tmp_path / "in")), None, names, root, name)
        seen += [count(), count()]
    assert seen == [1, 1, 2, 2, 2, 2]


def test_commit_log_lines(spark):
    lines = ["h1|h|Ann|a@b.c|2 days ago|1524398435|HEAD -> master, origin/master|fix a | b", "broken"]
    rows = commits.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(rows) == 1
    assert rows[0]["refs"] == ["HEAD -> master", "origin/master"] and rows[0]["message"] == "fix a | b"
    assert rows[0]["fs_date"] == "2018_04_22-12_00_35"


# Fields of a push event as the hosting service sends them.
PUSHED = {
    "ref": "refs/heads/master",
    "after": "e87eead2",
    "commits": [{"id": "e87eead2", "distinct": True, "message": "Change size", "timestamp": "2018-11-19T08:53:54+01:00"}],
    "head_commit": {"author": {"username": "dev"}},
    "repository": {"name": "bench", "html_url": "https://example.org/bench"},
}


def test_push_events(spark):
    payloads = [json.dumps(PUSHED), json.dumps({**PUSHED, "commits": "wrong", "ref": "refs/heads/wip"})]
    events = commits.parse_push_events(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    first = events.first()
    assert first["head_commit"]["author"]["username"] == "dev"
    assert first["commits"][0]["timestamp"] == "2018-11-19T08:53:54+01:00" and first["commits"][0]["distinct"] is True
    rows = commits.push_triggers(events, ["master", "release*"]).collect()
    assert [tuple(r) for r in rows] == [("bench", "e87eead2", "master", "https://example.org/bench")]
    assert events.where(branch_matches(F.col("ref"), "*")).count() == 2
    assert set(PUSH.fieldNames()) >= {"ref", "after", "commits"}


def test_report_stream_counts_every_file_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    write(tmp_path / "in" / "one.json", REPORT)
    write(tmp_path / "in" / "bad.json", '{"result": {')
    stream = lambda: intake.report_stream(spark, source, archive=str(tmp_path / "done"))
    intake.append_reports(stream(), table, checkpoint).awaitTermination(60)
    assert spark.read.parquet(table).count() == 1
    write(tmp_path / "in" / "two.json", REPORT)
    intake.append_reports(stream(), table, checkpoint).awaitTermination(60)
    assert spark.read.parquet(table).count() == 2


def test_trigger_stream_drops_repeated_events(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / "in" / f"{name}.json", PUSHED)
    write(tmp_path / "in" / "c.json", {**PUSHED, "ref": "refs/heads/wip"})
    query = (
        intake.trigger_stream(spark, str(tmp_path / "in"), ["master"])
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [r["branch"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["master"]


def test_streams_keep_failed_runs_and_late_files(spark, tmp_path):
    write(tmp_path / "in" / "failed.json", {"problem": {"returncode": 1}})
    intake.append_reports(intake.report_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    for name, age in (("a", 0), ("b", 3 * 86400)):
        write(tmp_path / "push" / f"{name}.json", {**PUSHED, "after": name})
        then = (tmp_path / "push" / f"{name}.json").stat().st_mtime - age
        os.utime(tmp_path / "push" / f"{name}.json", (then, then))
        query = (
            intake.trigger_stream(spark, str(tmp_path / "push"), ["master"])
            .writeStream.format("parquet").option("path", str(tmp_path / "runs"))
            .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        )
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_running_commit_stats(spark, tmp_path):
    write(tmp_path / "in" / "one.json", REPORT)
    write(tmp_path / "in" / "two.json", {**REPORT, "result": {"duration": 1.0}})
    stats = intake.running_commit_stats(intake.report_stream(spark, str(tmp_path / "in")))
    query = stats.writeStream.format("memory").queryName("fresh_stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    row = spark.table("fresh_stats").first()
    assert (row["hash"], row["items"], row["dur_min"]) == ("c1", 2, 1.0)
