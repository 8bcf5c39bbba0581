"""Canonical JSON, nested merging and look-ups on small literal values."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runledger.functions.documents import canonical_json, merge_nested, recursive_get


def shown(spark, value, kind):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(canonical_json(F.col("v"), df.schema["v"].dataType)).first()[0]


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        (None, "struct<a:int>", "null"),
        ({}, "map<string,int>", "{}"),
        ({"b": 1, "a": 2}, "map<string,int>", '{"a":2,"b":1}'),
        ((1, 2), "struct<b:int,a:int>", '{"a":2,"b":1}'),
        ((None, (None,)), "struct<b:int,a:struct<x:int>>", '{"a":{"x":null},"b":null}'),
        ([1 / 3, 2 / 3, 1.0, None], "array<double>", "[0.33,0.67,1.0,null]"),
        ([0.125, 0.375], "array<double>", "[0.12,0.38]"),
        ((1 / 3, [[1 / 3]]), "struct<plain:double,deep:array<array<double>>>", '{"deep":[[0.33]],"plain":0.3333333333333333}'),
        (dt.datetime(2018, 4, 22, 12, 0, 35), "timestamp_ntz", '"2018/04/22-12:00:35"'),
        ([dt.datetime(2018, 4, 22, 12, 0, 35)], "array<timestamp_ntz>", '["2018/04/22-12:00:35"]'),
        ('a "quoted"\n[text]', "string", '"a \\"quoted\\"\\n[text]"'),
        (None, "string", "null"),
        (5, "int", "5"),
        ({2: [{"z": 1, "a": None}]}, "map<int,array<map<string,int>>>", '{"2":[{"a":null,"z":1}]}'),
    ],
)
def test_canonical_json(spark, value, kind, want):
    assert shown(spark, value, kind) == want
    json.loads(want)


LEFT = "struct<a:struct<x:int,y:int>,m:map<string,int>,only:int,both:int>"
RIGHT = "struct<a:struct<y:int,z:int>,m:map<string,int>,both:string,more:int>"


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        (((1, 2), {"p": 1, "q": 2}, 3, 4), ((5, 6), {"q": 7}, "s", 8), {"a": {"x": 1, "y": 5, "z": 6}, "both": "s", "m": {"p": 1, "q": 7}, "more": 8, "only": 3}),
        (((1, 2), None, 3, 4), ((None, 6), {"q": 7}, None, 8), {"a": {"x": 1, "y": None, "z": 6}, "both": None, "m": {"q": 7}, "more": 8, "only": 3}),
        (((1, 2), {"p": 1}, 3, 4), None, {"a": {"x": 1, "y": 2, "z": None}, "both": "4", "m": {"p": 1}, "more": None, "only": 3}),
        (None, (None, None, "s", 8), {"a": None, "both": "s", "m": None, "more": 8, "only": None}),
        (None, None, None),
    ],
)
def test_merge_nested(spark, left, right, want):
    df = spark.createDataFrame([(left, right)], f"l {LEFT}, r {RIGHT}")
    merged = df.select(merge_nested(F.col("l"), df.schema["l"].dataType, F.col("r"), df.schema["r"].dataType).alias("m"))
    text = merged.select(canonical_json(F.col("m"), merged.schema["m"].dataType)).first()[0]
    assert json.loads(text) == want


@pytest.mark.parametrize(
    ("path", "sep", "want"),
    [("foo", ".", {"bar": 5, "none": None, "a.b": 1}), ("foo.bar", ".", 5), ("bar.foo", ".", "default"), ("foo.bar.x", ".", "default"),
     ("foo.none", ".", None), ("foo|bar", "|", 5), ("foo|foo", "|", "default"), ("foo/a.b", "/", 1), ("foo.bar", "", "default")],
)
def test_recursive_get(spark, path, sep, want):
    df = spark.createDataFrame([(json.dumps({"foo": {"bar": 5, "none": None, "a.b": 1}}),)], "t string").select(F.parse_json("t").alias("v"))
    found = recursive_get(F.col("v"), path, F.parse_json(F.lit('"default"')), sep)
    assert json.loads(df.select(F.to_json(found)).first()[0]) == want
    missing = df.select(recursive_get(F.col("v"), path, sep=sep).isNull()).first()[0]
    assert missing == (want == "default")
