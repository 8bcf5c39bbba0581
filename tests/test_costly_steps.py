"""Costly steps are worked out once, however often their results are used."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.catalog import load
from runledger.operators import tree
from runledger.sources import reports, store

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_added_to_a_profile_does_not_multiply_its_metrics(spark):
    texts = [("p", '{"run-process-count": "2", "children": [{"tag": "A", "cumul-time-sum": 8, "file-line": "3", "children": [{"tag": "b"}, 7]}]}'), ("none", "{}"), ("bad", "{x")]
    df = spark.createDataFrame(texts, "source_path string, content string")
    rows = reports.collect(df, "profiler-report").withColumn("result", F.col("result").withField("returncode", F.lit(0)))
    assert plan(rows).count("variant_get(") < 10
    got = {r["source_path"]: r for r in rows.collect()}
    assert set(got) == {"p", "none"} and got["none"]["result"] is None and got["none"]["timers"] is None or got["none"]["timers"] == []
    assert (got["p"]["result"]["duration"], got["p"]["result"]["file-line"], got["p"]["result"]["returncode"]) == (4.0, 3, 0)
    assert [(t["path"], t["duration"]) for t in got["p"]["timers"]] == [("/a", 8.0), ("/a/b", None), (None, None)]


def saved_plans(spark, monkeypatch, name):
    found, save = [], store.save

    def spy(rows, logs, *others):
        found.extend(plan(x) for x in (rows, logs) if x is not None)
        return save(rows, logs, *others)

    monkeypatch.setattr(store, "save", spy)
    load().QUERIES[name](spark, SMOKE)
    return found


def test_saved_reports_are_parsed_once(spark, monkeypatch):
    plans = saved_plans(spark, monkeypatch, "saved_reports")
    assert len(plans) == 8 and not any("parseJson" in p or "parse_json" in p or "Join" in p for p in plans)


def test_reports_of_a_stored_view_are_parsed_once(spark, monkeypatch):
    plans = saved_plans(spark, monkeypatch, "stored_view")
    assert len(plans) == 2 and not any("parseJson" in p or "parse_json" in p for p in plans)


def test_members_of_a_section_are_listed_once(spark):
    df = spark.createDataFrame([("a", '{"x": 1, "problem": {"cpu": 2, "queue": "q"}, "timers": [{"name": "n", "m": 3}, 4]}')], "k string, content string")
    rows = reports.parse_reports(df)
    # One list of members for the text and one for each of the schema's seven objects.
    assert plan(rows).count("MapType(StringType,VariantType") <= 8
    row = rows.select(*[F.to_json(c).alias(c) for c in ("rest", "problem", "timers")]).first()
    assert row["rest"] == '{"x":1}' and row["problem"] == '{"cpu":2,"rest":{"queue":"q"}}'
    assert row["timers"] == '[{"name":"n","rest":{"m":3}},{"rest":4}]'


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_whose_logs_are_kept_do_not_pass_the_driver(spark, tmp_path):
    runs = spark.range(300).select(F.col("id").cast("string").alias("run_id"), F.struct((F.col("id") % 3).alias("returncode")).alias("problem"))
    runs = runs.withColumn("result", F.struct(F.lit(None).cast("int").alias("returncode")))
    files = runs.select("run_id", F.lit("a.log").alias("filename"), F.lit("x").cast("binary").alias("data"))
    kept = store.log_files(runs, files, "on-error")
    assert "Broadcast" not in physical(kept) and kept.count() == 200


def test_known_keys_do_not_pass_the_driver(spark):
    old = spark.range(0, 200).select(F.col("id").cast("string").alias("_id"), F.lit("old").alias("x"))
    # One key holds most of the rows.
    rows = spark.range(100, 5000).select(F.least("id", F.lit(250)).cast("string").alias("_id"), F.lit("new").alias("x"))
    new = store._new(rows, old, ["_id"])
    assert "Broadcast" not in physical(new)
    # Rows of a key meet before they are dealt to tasks: under the one exchange stands an aggregation.
    assert physical(new).count("Exchange") == 1 and "partial_first(" in physical(new).split("Exchange")[1]
    assert sorted(int(r["_id"]) for r in new.collect()) == list(range(200, 251)) and {r["x"] for r in new.collect()} == {"new"}


def test_ids_of_saved_reports_are_not_guessed_to_be_few(spark, tmp_path):
    texts = spark.createDataFrame([(str(i), '{"git": {"datetime": "2024-01-02T03:04:05"}, "x": 1}') for i in range(4)], "_id string, content string")
    rows, names, root = reports.parse_reports(texts), store.TableNames.of("p"), str(tmp_path / "db")
    store.save(rows.where("_id < 2"), None, names, root, "early")
    new = store._new(store.report_ids(rows), store.saved_reports(spark, names, root), ["_id"])
    # Only the names of finished batches are broadcast.
    joins = [line for line in physical(new).splitlines() if "Join " in line]
    assert len(joins) == 1 and "BroadcastHashJoin [batch" in joins[0]
    assert sorted(r["_id"] for r in new.collect()) == ["2", "3"]


def test_nodes_come_with_the_texts_of_their_fields(spark):
    odd = [1.5, 100.0, 1e-7, 12, -0.0, 10**20, True, None, "x", " 7 ", "", [1, {"a": 2.5}], {"b": "c"}, "\ud800", "ä\U0001f600", float("1e999")]
    nodes = [{"tag": f"t{i}", "cumul-time-sum": v, "file-path": v, "file-line": v, "other": 1} for i, v in enumerate(odd)]
    texts = [("odd", json.dumps({"children": [{"tag": "root", "children": nodes}, {"tag": "second"}]}).replace("Infinity", "1e999"))]
    texts += [("plain", '{"children": [{"tag": "A", "cumul-time-sum": "2", "children": [null, {"tag": 3, "function": "f"}]}]}'), ("none", '{"children": []}'), ("null", None), ("number", "7")]
    df = spark.createDataFrame(texts, "k string, json string")
    walked = tree.with_nodes(df, "json")
    # The document goes to the worker and does not come back, and no JSON text of a plain node is made or parsed.
    assert walked.columns == ["k", "nodes"]
    got = {r["k"]: r["nodes"] for r in walked.collect()}
    assert got["number"] is None and got["null"] == got["none"] == []
    assert [(n["name"], n["path"], n["texts"]["function"]) for n in got["plain"]] == [("a", "/a", None), (None, None, None), ("3", "/a/3", "f")]
    # As one cast of the node's variant gives them.
    one = tree.tree_rows(df.where("k = 'odd'"), "k", "json").orderBy("pos").select("tag", "path", tree.node_texts(F.col("node")).alias("texts")).collect()
    fields = lambda texts: texts and [texts[f] for f in tree.TEXTS]
    assert [(n["name"], n["path"], fields(n["texts"])) for n in got["odd"]] == [(n["tag"], n["path"], fields(n["texts"])) for n in one]


def nested(levels, **fields):
    node = {"tag": "Leaf x", "cumul-time-sum": "1", **fields}
    for i in range(levels - 1):
        node = {"tag": f"N{i}", "function": None if i % 2 else "ä", "children": [node, None, {"tag": "s", "file-line": "3", "children": []}]}
    return json.dumps({"other": [1.5, {"children": 2}], "children": [node, {"tag": "second"}]}, indent=levels % 3 or None)


def test_levels_of_many_documents_are_read_at_once(spark):
    texts = pa.array([nested(1), nested(2), None, nested(7), "", "{}", nested(3), '{"children": null}', nested(16)], pa.string())
    levels = list(tree.LEVELS)
    found, want = tree._walk_levels(texts, {}, True, levels), tree._walk_each(texts, {}, True)
    assert levels == [16]
    as_lists = lambda f: ([int(x) for x in f[0]], [bool(x) for x in f[1]], [c.to_pylist() for c in f[2]], f[3])
    assert as_lists(found) == as_lists(want)


@pytest.mark.parametrize("text", [nested(17), "7", "null", "[{}]", "{x", " ", "{} {}", "{}, {}", nested(1, function=1.5), '{"children": [7]}', '{"children": {"tag": "a"}}', '{"children": [{"tag": "a", "tag": "b"}]}'])
def test_other_documents_are_walked_one_by_one(text):
    assert tree._walk_levels(pa.array(["{}", text, nested(1)]), {}, True, list(tree.LEVELS)) is None
