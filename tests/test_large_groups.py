"""The plans for groups of any size against brute force, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.operators.clusters import anchored_clusters
from runledger.operators.ordering import first_rows, previous_value, running_total
from runledger.operators import quantiles
from runledger.operators.quantiles import aggregate_with_percentiles, group_percentiles
from runledger.sizing import keyed_join

PROBABILITIES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def values(kind: str) -> dict[str, list[float]]:
    state = random.Random(7)
    hot = {
        "uniform": [state.random() for _ in range(1500)],
        "ties": [float(state.randrange(3)) for _ in range(1500)],
        "heavy": [state.choice([-1, 1]) * 10.0 ** state.uniform(-20, 20) for _ in range(800)],
        "narrow": [1e6 + state.random() * 1e-6 for _ in range(800)],
    }[kind]
    return {"hot": hot, "one": [3.5], "two": [1.0, 2.0], "same": [2.0] * 9}


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy", "narrow"])
def test_percentiles_agree_with_numpy_and_with_spark(spark, kind):
    data = values(kind)
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), (None, 1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    own = [F.percentile("v", p).alias(name) for name, p in PROBABILITIES.items()]
    short = {r["k"]: r for r in df.groupBy("k").agg(*own).collect()}
    long = {r["k"]: r for r in group_percentiles(df, ["k"], "v", PROBABILITIES).collect()}
    assert set(short) == set(long) == {*data, None}
    for k, vs in {**data, None: [1.0, 5.0]}.items():
        want = np.percentile(vs, [100 * p for p in PROBABILITIES.values()])
        for name, w in zip(PROBABILITIES, want, strict=True):
            assert long[k][name] == short[k][name]
            assert long[k][name] == pytest.approx(w, rel=1e-12)


def test_percentiles_of_odd_values_end(spark):
    """Infinities, NaN (the largest), denormals and 600 decades: ranks are those of a sort."""
    inf, nan, least = float("inf"), float("nan"), 5e-324
    state = random.Random(11)
    data = {
        "inf": [1.0, 2.0, inf],
        "minus": [-inf, -inf, 0.0, 3.0, inf],
        "nan": [nan, 1.0, nan, 2.0, -1.0],
        "least": [0.0, least, least, 4 * least, 5 * least],
        "wide": [state.choice([-1, 1]) * 10.0 ** state.uniform(-300, 300) for _ in range(101)],
        "edges": [1.7e308, -1.7e308, 0.0, -0.0, 2.0**-1074],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    places = {"p0": 0.0, "p50": 0.5, "p100": 1.0}
    got = {r["k"]: r for r in group_percentiles(df, ["k"], "v", places).collect()}
    for k, vs in data.items():
        vs = sorted(vs, key=lambda v: (v != v, v))
        for name, p in places.items():
            want = vs[int(p * (len(vs) - 1))]
            assert got[k][name] == want or (want != want and got[k][name] != got[k][name])


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy", "narrow"])
@pytest.mark.parametrize(("sketch", "counted"), [(100, 1 << 22), (100, 60)])
def test_percentiles_beyond_the_sketch(spark, kind, sketch, counted):
    """Brackets and counting decide, after one sketch or several."""
    data = values(kind)
    hot = [*data["hot"] * 3, float("inf"), float("-inf")]
    rows = [("hot", v) for v in hot] + [("nan", v) for v in [*data["hot"], *[float("nan")] * 700]] + [("one", 3.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    places = {"p0": 0.0, **PROBABILITIES, "p100": 1.0}
    # Small sketches are less exact than SLACK assumes; a wider one only counts more.
    wide, quantiles.SLACK = quantiles.SLACK, 0.2
    try:
        got = aggregate_with_percentiles(df, ["k"], [F.count("v").alias("n")], "v", places, sketch, counted)
        got = {r["k"]: r for r in got.collect()}
    finally:
        quantiles.SLACK = wide
    own = df.groupBy("k").agg(*[F.percentile("v", p).alias(name) for name, p in places.items()])
    for r in own.collect():
        assert {n: str(got[r["k"]][n]) for n in places} == {n: str(r[n]) for n in places}
    assert got["hot"]["n"] == len(hot)


def test_percentiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    row = group_percentiles(df, [], "v", {"a": 0.25, "b": 0.5}).first()
    assert (row["a"], row["b"]) == (25.0, 50.0)


def test_running_total(spark):
    state = random.Random(3)
    rows = [(state.choice(["hot"] * 8 + ["a", None]), state.randrange(50), i, state.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, w int").repartition(6)
    got = running_total(df, ["k"], [F.col("t"), F.col("id")], F.col("w").cast("bigint"), "total").collect()
    totals: dict = {}
    want = {}
    for k, t, i, w in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        totals[k] = totals.get(k, 0) + w
        want[i] = totals[k]
    assert {r["id"]: r["total"] for r in got} == want


def test_row_numbers(spark):
    state = random.Random(5)
    rows = [(state.choice(["hot"] * 8 + ["a", None]), state.randrange(9), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(7)
    got = running_total(df, ["k"], [F.desc("t"), F.col("id")]).collect()
    seen: dict = {}
    want = {}
    for k, _, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r["id"]: r["row_no"] for r in got} == want


def test_previous_value(spark):
    rows = [("a", i, i // 3) for i in range(40)] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    got = {(r["k"], r["t"]): r["before"] for r in previous_value(df, ["k"], [F.col("t")], "v", "before").collect()}
    assert got[("a", 0)] is None and got[("b", 5)] is None
    assert all(got[("a", i)] == (i - 1) // 3 for i in range(1, 40))


def brute_clusters(times: list[int], gap: int) -> dict[int, int]:
    result, start, number = {}, None, -1
    for t in sorted(set(times)):
        if start is None or t - start > gap:
            start, number = t, number + 1
        result[t] = number
    return result


@pytest.mark.parametrize("gap", [1, 37])
@pytest.mark.parametrize("stretch", [1 << 22, 100, 1])
def test_anchored_clusters(spark, gap, stretch):
    state = random.Random(gap)
    data = {
        "dense": list(range(100, 300)),
        "hot": [state.randrange(2000) for _ in range(900)],
        "sparse": [state.randrange(50) * 500 for _ in range(30)],
        "example": [1, 5, 12, 14, 30],
        "single": [77],
        "early": [-500, -499, -460, -3, 0, 36, 37, 38, 75],
        None: [5, 50, 900],
    }
    rows = [(k, t, gap) for k, ts in data.items() for t in ts] + [("hot", None, gap)]
    df = spark.createDataFrame(rows, "k string, t bigint, gap bigint")
    got = anchored_clusters(df, ["k"], "t", "gap", stretch=stretch).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["cluster"] == brute_clusters(data[r["k"]], gap).get(r["t"]), (r, gap)


def test_clusters_without_groups(spark):
    df = spark.range(0, 5_000, 3).select("id", F.lit(10).alias("gap")).repartition(5)
    got = anchored_clusters(df, [], "id", "gap", stretch=50).collect()
    assert {r["id"]: r["cluster"] for r in got} == brute_clusters(list(range(0, 5_000, 3)), 10)
    assert anchored_clusters(df.limit(0), [], "id", "gap").count() == 0


def test_first_rows_cuts_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = first_rows(df, ["k"], [F.desc("id")], 2)
    assert sorted(r["id"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_keyed_join_matches_nulls_and_itself(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    counts = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert sorted(r["s"] for r in keyed_join(df, counts, ["k"]).collect()) == [1, 2]
