"""Scalar expressions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.registry import REPORTS, query
from runledger.functions import dates, text
from runledger.functions.documents import canonical_json, merge_nested, recursive_get
from runledger.functions.numbers import round_even
from runledger.operators.reshape import merge_maps
from runledger.sources import tables


@query(
    "safe_name",
    """SELECT page_id, coalesce(regexp_replace(url, '[^a-zA-Z0-9_-]+', '-', 'g'), '') AS name FROM pages""",
)
def safe_name(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(
    "parse_bool",
    """SELECT event_id AS _id, w AS word, CASE WHEN lower(w) IN ('yes', 'true', '1') THEN true WHEN lower(w) IN ('no', 'false', '0') THEN false END AS flag
    FROM (SELECT event_id, ['Yes', 'TRUE', '1', 'no', 'False', '0', 'maybe'][(user_id % 7 + 1)::INT] AS w FROM events)""",
)
def parse_bool(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("Yes", "TRUE", "1", "no", "False", "0", "maybe")])
    rows = tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_id"), F.element_at(words, (F.col("user_id") % 7 + 1).cast("int")).alias("word")
    )
    return rows.withColumn("flag", text.parse_bool(F.col("word")))


@query(
    "kv_options",
    f"""WITH {REPORTS} SELECT id AS _id, size::BIGINT AS size, (weak = 1) AS scaled, test AS word, CASE WHEN cpu > 2 THEN NULL ELSE cpu::BIGINT END AS cpu,
       CASE WHEN cpu > 2 THEN cpu || 'x' END AS cpu_word FROM reports""",
)
def kv_options(spark, sf_dir):
    cpu = F.concat(F.col("problem.cpu"), F.when(F.col("problem.cpu") > 2, "x").otherwise(""))
    options = F.array(
        F.concat(F.lit("size="), F.split("problem.mesh", "_")[1]),
        F.concat(F.lit("scaled="), F.when(F.col("problem.weak") == 1, "True").otherwise("false")),
        F.concat(F.lit("test="), F.col("problem.test-name")),
        F.concat(F.lit("cpu="), cpu),
    )
    rows = tables.reports(spark, sf_dir).select("_id", options.alias("options"))

    def typed(key: str):
        return text.typed_option(text.option_value(F.col("options"), F.lit(key)))

    return rows.select(
        "_id",
        typed("size")["number"].alias("size"),
        typed("scaled")["flag"].alias("scaled"),
        typed("test")["word"].alias("word"),
        typed("cpu")["number"].alias("cpu"),
        typed("cpu")["word"].alias("cpu_word"),
    )


@query(
    "line_value",
    r"""WITH t AS (SELECT doc_id, string_split(trim('HEAD "x" of ' || source || chr(10) || text || chr(10) || 'VERSION="' || lang || '-' || n_chars || '"'), chr(10)) AS l FROM documents)
    SELECT doc_id, replace(coalesce(list_filter(l, lambda s: starts_with(s, 'VERSION='))[1][9:], l[1]), '"', '') AS version,
       replace(coalesce(list_filter(l, lambda s: starts_with(s, 'NO SUCH PREFIX='))[1][16:], l[1]), '"', '') AS fallback FROM t""",
)
def line_value(spark, sf_dir):
    output = F.concat(
        F.lit('HEAD "x" of '), "source", F.lit("\n"), "text", F.lit('\nVERSION="'), "lang", F.lit("-"), "n_chars", F.lit('"')
    )
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", output.alias("output"))
    return rows.select(
        "doc_id",
        text.line_value(F.col("output"), "VERSION=").alias("version"),
        text.line_value(F.col("output"), "NO SUCH PREFIX=").alias("fallback"),
    )


@query(
    "epoch_units",
    """SELECT event_id AS _id, s::DOUBLE AS seconds, round(s / 60.0::DOUBLE, 6) AS minutes, round(s / 3600.0::DOUBLE, 6) AS hours, round(s / 86400.0::DOUBLE, 6) AS days
    FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)""",
)
def epoch_units(spark, sf_dir):
    units = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
    ts = F.col("ts")
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_id"), *[F.round(dates.epoch_in(ts, n), 6).alias(name) for name, n in units.items()]
    )


@query(
    "date_formats",
    """SELECT event_id AS _id, strftime(ts, '%Y/%m/%d-%H:%M:%S') AS long, strftime(ts, '%Y/%m/%d') AS short, strftime(ts, '%Y_%m_%d-%H_%M_%S') AS file,
       strftime(date_trunc('second', ts), '%Y/%m/%d-%H:%M:%S') AS back FROM events""",
)
def date_formats(spark, sf_dir):
    ts = F.col("ts")
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_id"),
        dates.long_format(ts).alias("long"),
        dates.short_format(ts).alias("short"),
        dates.file_stamp(ts).alias("file"),
        dates.long_format(dates.from_epoch(dates.epoch_seconds(ts))).alias("back"),
    )


@query(
    "human_interval",
    """WITH s AS (SELECT event_id, date_trunc('minute', ts) AS b, ts + (user_id * user_id * 23) * INTERVAL 1 SECOND AS e FROM events),
    d AS (SELECT event_id, (epoch_us(e) - epoch_us(b)) // 1000000 AS s FROM s)
    SELECT event_id AS _id, CASE WHEN s >= 86400 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END
      WHEN s >= 3600 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END
      ELSE (s // 60) || ' minute' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END END AS took FROM d""",
)
def human_interval(spark, sf_dir):
    start = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    end = F.timestamp_add("SECOND", F.col("user_id") * F.col("user_id") * 23, F.col("ts"))
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_id"), dates.human_interval(start, end).alias("took")
    )


@query(
    "map_merge",
    f"""WITH {REPORTS} SELECT id AS _id, 'a=' || test || ',b=' || cpu || ',c=' || branch AS merged FROM reports""",
)
def map_merge(spark, sf_dir):
    left = F.create_map(F.lit("a"), F.col("problem.test-name"), F.lit("b"), F.lit("old"))
    right = F.create_map(F.lit("b"), F.col("problem.cpu").cast("string"), F.lit("c"), F.col("git.branch"))
    merged = merge_maps(left, right)
    entries = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return tables.reports(spark, sf_dir).select("_id", F.array_join(entries, ",").alias("merged"))


@query(
    "default_if_null",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def default_if_null(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id")
    labels = tables.table(spark, sf_dir, "labels")
    rows = documents.join(labels, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query(
    "json_output",
    """SELECT event_id AS _id, '{"at":"' || strftime(ts, '%Y/%m/%d-%H:%M:%S') || '","cpu":' || (1 + user_id % 4) || ',"test":"' || event_type || '"}' AS json FROM events""",
)
def json_output(spark, sf_dir):
    """Sorted keys and long dates, as the result encoder writes them."""
    fields = F.struct(F.col("event_type").alias("test"), (F.col("user_id") % 4 + 1).alias("cpu"), F.col("ts").alias("at"))
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), fields.alias("value"))
    return rows.select("_id", canonical_json(F.col("value"), rows.schema["value"].dataType).alias("json"))


@query(
    "json_nested",
    """SELECT event_id AS _id, '{"a":{"list":[' || (user_id % 4) || '.5,' || (user_id % 4) || '.12,null],"none":null},"b":{"' || event_type
      || '":{"x":null,"y":' || (user_id % 3) || '}},"when":["' || strftime(ts, '%Y/%m/%d-%H:%M:%S') || '"]}' AS json FROM events""",
)
def json_nested(spark, sf_dir):
    """Keys sorted at all levels, nulls kept, numbers of lists with two digits."""
    whole = (F.col("user_id") % 4).cast("double")
    value = F.struct(
        F.array("ts").alias("when"),
        F.create_map(F.col("event_type"), F.struct((F.col("user_id") % 3).alias("y"), F.lit(None).cast("int").alias("x"))).alias("b"),
        F.struct(F.lit(None).cast("string").alias("none"), F.array(whole + 0.5, whole + 0.1225, F.lit(None)).alias("list")).alias("a"),
    )
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), value.alias("value"))
    return rows.select("_id", canonical_json(F.col("value"), rows.schema["value"].dataType).alias("json"))


@query(
    "nested_merge",
    f"""WITH {REPORTS} SELECT id AS _id, '{{"git":{{"branch":"' || branch || '","tag":"new"}},"map":{{"a":"' || test || '","b":"2","c":"3"}},"problem":{{"cpu":'
      || (cpu + 1) || ',"mesh":null,"test":"' || test || '"}},"result":' || CASE WHEN returncode = 1 THEN '1' ELSE '2' END || '}}' AS json FROM reports""",
)
def nested_merge(spark, sf_dir):
    """Structs within structs and maps are merged; a null that is there stands before a value."""
    failed = F.col("result.returncode") == 1
    left = F.struct(
        F.struct(F.col("problem.test-name").alias("test"), F.col("problem.cpu").alias("cpu"), F.col("problem.mesh").alias("mesh")).alias("problem"),
        F.struct(F.col("git.branch").alias("branch")).alias("git"),
        F.create_map(F.lit("a"), F.col("problem.test-name"), F.lit("b"), F.lit("1")).alias("map"),
        F.lit(1).alias("result"),
    )
    right = F.struct(
        F.struct((F.col("problem.cpu") + 1).alias("cpu"), F.lit(None).cast("string").alias("mesh")).alias("problem"),
        F.struct(F.lit("new").alias("tag")).alias("git"),
        F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")).alias("map"),
        F.when(failed, 1).otherwise(2).alias("result"),
    )
    rows = tables.reports(spark, sf_dir).select("_id", left.alias("l"), right.alias("r"))
    merged = merge_nested(F.col("l"), rows.schema["l"].dataType, F.col("r"), rows.schema["r"].dataType)
    rows = rows.select("_id", merged.alias("m"))
    return rows.select("_id", canonical_json(F.col("m"), rows.schema["m"].dataType).alias("json"))


@query(
    "recursive_get",
    f"""WITH {REPORTS} SELECT id AS _id, cpu, CASE WHEN returncode = 1 THEN 'none' ELSE CASE WHEN cpu = 1 THEN 'null' ELSE test END END AS name FROM reports""",
)
def variant_lookup(spark, sf_dir):
    """The default stands for a missing member, not for one that is null."""
    failed, single = F.col("result.returncode") == 1, F.col("problem.cpu") == 1
    name = F.when(failed, "").when(single, ', "name": null').otherwise(F.concat(F.lit(', "name": "'), F.col("problem.test-name"), F.lit('"')))
    text = F.concat(F.lit('{"problem": {"cpu": '), F.col("problem.cpu"), name, F.lit("}}"))
    rows = tables.reports(spark, sf_dir).select("_id", F.parse_json(text).alias("document"))
    found = recursive_get(F.col("document"), "problem.name", F.parse_json(F.lit('"none"')))
    shown = F.when(F.is_variant_null(found), "null").otherwise(F.try_variant_get(found, "$", "string"))
    return rows.select("_id", F.try_variant_get(recursive_get(F.col("document"), "problem/cpu", sep="/"), "$", "int").alias("cpu"), shown.alias("name"))


@query(
    "round_even",
    """SELECT l_orderkey, l_quantity, CASE WHEN (h - floor(h)) = 0.5 THEN 2 * round(h / 2) ELSE round(h) END AS rounded
    FROM (SELECT l_orderkey, l_quantity, l_quantity / 2 AS h FROM lineitem)""",
)
def rounding(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", round_even(F.col("l_quantity") / 2, 0).alias("rounded")
    )
