import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.functions import tails
from runledger.operators import aggregates, statistics


def t_density(x, d):
    return math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(d * math.pi) * (1 + x * x / d) ** (-(d + 1) / 2)


def integrated_two_sided(t, d):
    xs = np.linspace(0, abs(t), 200_001)
    ys = np.array([t_density(x, d) for x in xs])
    return 1 - 2 * np.trapezoid(ys, xs)


@pytest.mark.parametrize(("df", "t"), [(1, 12.7062047364), (2, 4.3026527297), (4, 2.7764451052), (100, 1.9839715185), (5000, 1.9604386)])
def test_t_quantile(df, t):
    assert tails.t_quantile([df])[0] == pytest.approx(t, rel=1e-7)


def test_t_quantile_is_continuous_where_the_method_changes():
    a, b = tails.t_quantile([1000, 1000.0001])
    assert a == pytest.approx(b, rel=1e-9)
    assert np.isnan(tails.t_quantile([0])[0])


@pytest.mark.parametrize(("t", "d"), [(0.3, 1), (2.0, 10), (1.5, 7.37), (-2.5, 33.3)])
def test_t_tail_against_integration(t, d):
    assert tails.t_two_sided([t], [d])[0] == pytest.approx(integrated_two_sided(t, d), abs=1e-9)


@pytest.mark.parametrize(("f", "d2"), [(0.5, 4), (4.0, 10), (30.0, 100), (0.0, 3)])
def test_f_tail_closed_form_for_two_groups_of_freedom(f, d2):
    assert tails.f_survival([f], [2], [d2])[0] == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-12)


def test_f_tail_of_unusable_input():
    assert np.isnan(tails.f_survival([np.nan], [2], [3])[0])
    assert tails.f_survival([np.inf], [2], [3])[0] == 0


# Walltimes of the published example, tag reps-075.
EXAMPLE = [5.420462, 5.466273, 5.391954, 5.321612, 5.351176]


def test_point_stats_of_the_example(spark):
    df = spark.createDataFrame([("reps-075", v) for v in EXAMPLE] + [("one", 2.0), (None, 1.0)], "tag string, v double")
    rows = {r["tag"]: r for r in aggregates.point_stats(df, ["tag"], "v").collect()}
    assert set(rows) == {"reps-075", "one"}
    r = rows["reps-075"]
    assert r["n"] == 5
    assert r["std"] == pytest.approx(np.std(EXAMPLE, ddof=1))
    assert r["ci"] == pytest.approx(np.std(EXAMPLE, ddof=1) / math.sqrt(5) * 2.7764451052, rel=1e-8)
    assert (r["median"], r["min"], r["max"]) == (5.391954, 5.321612, 5.466273)
    assert rows["one"]["std"] is None and rows["one"]["ci"] is None and rows["one"]["median"] == 2.0


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        aggregates.point_stats(spark.range(1), ["id"], "id", ("mode",))


def test_anova_two_groups_equals_squared_t(spark):
    a, b = [1.0, 2.0, 3.0, 4.5], [2.5, 3.5, 5.0]
    df = spark.createDataFrame([("t", "a", v) for v in a] + [("t", "b", v) for v in b], "test string, g string, v double")
    r = statistics.anova(df, ["test"], "g", "v").first()
    pooled = (3 * np.var(a, ddof=1) + 2 * np.var(b, ddof=1)) / 5
    t = (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 4 + 1 / 3))
    assert (r["df_between"], r["df_within"]) == (1, 5)
    assert r["f"] == pytest.approx(t * t)
    assert r["p_value"] == pytest.approx(integrated_two_sided(t, 5), abs=1e-9)


def test_anova_without_spread_has_no_statistic(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    r = statistics.anova(df, [], "g", "v").first()
    assert r["f"] is None and r["p_value"] is None


def test_anova_keeps_its_digits_far_from_zero(spark):
    base = [0.1, 0.2, 0.3, 0.4, 0.9]
    rows = [(g, 1e8 + v + (0.5 if g == "b" else 0.0)) for g in "ab" for v in base]
    shifted = statistics.anova(spark.createDataFrame(rows, "g string, v double"), [], "g", "v", False).first()["f"]
    plain = [(g, v - 1e8) for g, v in rows]
    assert shifted == pytest.approx(statistics.anova(spark.createDataFrame(plain, "g string, v double"), [], "g", "v", False).first()["f"], rel=1e-6)


def test_normality_needs_eight_values(spark):
    rows = [("few", float(i)) for i in range(7)] + [("flat", 1.0)] * 20 + [("many", math.sin(i) * 3) for i in range(60)]
    got = {r["k"]: r for r in statistics.normality(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["few"]["p_value"] == 0.0 and got["flat"]["p_value"] == 0.0
    assert 0 < got["many"]["p_value"] < 1


def test_welch_p_value(spark):
    a, b = [1.0, 2.0, 3.0, 4.5], [2.5, 3.5, 5.0, 9.0, 1.0]
    df = spark.createDataFrame([(1, v) for v in a] + [(2, v) for v in b] + [(3, 1.0)], "cpu int, v double")
    rows = statistics.welch_against_baseline(df, [], "cpu", "v").collect()
    assert [(r["setting_a"], r["setting_b"]) for r in rows] == [(1, 2)]
    r = rows[0]
    ea, eb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    t = (np.mean(a) - np.mean(b)) / math.sqrt(ea + eb)
    dof = (ea + eb) ** 2 / (ea**2 / 3 + eb**2 / 4)
    assert (r["t"], r["dof"]) == (pytest.approx(t), pytest.approx(dof))
    assert r["p_value"] == pytest.approx(integrated_two_sided(t, dof), abs=1e-8)
    assert r["reject"] is False


def power_fixture(spark):
    tags = {"reps-100": 1.0, "reps-200": 2.0}
    rows = [(True, tag, base + 0.001 * i, i) for tag, base in tags.items() for i in range(30)]
    df = spark.createDataFrame(rows, "excl boolean, tag string, walltime double, id int")
    pairs = [("same", True, "reps-100", "reps-100"), ("twice", True, "reps-100", "reps-200")]
    return df, spark.createDataFrame(pairs, "experiment string, excl boolean, group_a string, group_b string")


def test_anova_power(spark):
    df, experiments = power_fixture(spark)
    order = [F.col("walltime"), F.col("id")]
    p = statistics.anova_power(df, experiments, ["excl"], "tag", "walltime", order, [3, 10, 31], 6)
    rows = p.collect()
    assert {(r["experiment"], r["sample_size"]) for r in rows} == {(e, s) for e in ("same", "twice") for s in (3, 10)}
    assert len(rows) == 2 * 2 * 6
    assert all(r["df_within"] == 2 * r["sample_size"] - 2 for r in rows)
    assert all(r["p_value"] < 1e-3 for r in rows if r["experiment"] == "twice")
    again = {(r["experiment"], r["sample_size"], r["rep"]): r["p_value"] for r in p.collect()}
    assert again == {(r["experiment"], r["sample_size"], r["rep"]): r["p_value"] for r in rows}
    found = {r["experiment"]: r["sample_size"] for r in statistics.smallest_detecting_size(p, ["excl", "experiment"]).collect()}
    assert found == {"twice": 3}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 100, 101, 1000])
def test_permutation_moves_each_index_once(spark, size):
    a = int(np.ceil(np.sqrt(size)))
    total = a * -(-size // a)
    seen = []
    for key in ("x", "y"):
        rows = spark.range(total).withColumn("n", F.lit(size).cast("long"))
        seen.append([r["to"] for r in statistics.permuted(rows, "id", "n", [F.lit(key)], "to").orderBy("id").collect()])
        assert sorted(seen[-1]) == list(range(total))
    assert size < 10 or seen[0] != seen[1]


def test_samples_are_distinct_nested_and_even(spark):
    groups = spark.createDataFrame([("e", 200, 7), ("f", 50, 60), ("g", 1, 9)], "experiment string, n_a long, n_b long")
    drawn = statistics.sampling_design(groups, ["experiment"], [2, 5, 40], 300, 9).collect()
    cells, hits = {}, {}
    for r in drawn:
        cells.setdefault((r["experiment"], r["rep"], r["side"]), {})[r["place"]] = r["row_no"]
        hits[r["experiment"], r["side"], r["row_no"]] = hits.get((r["experiment"], r["side"], r["row_no"]), 0) + 1
    assert len(cells) == 2 * 300 * 2  # no size fits g
    for (experiment, _, side), places in cells.items():
        most, n = (5, {"a": 200, "b": 7}[side]) if experiment == "e" else (40, {"a": 50, "b": 60}[side])
        assert sorted(places) == list(range(1, most + 1)) and len(set(places.values())) == most
        assert all(1 <= row <= n for row in places.values())
    # Each of 7 rows is drawn in 5 of 7 repetitions: 214 of 300, give or take 8.
    assert all(170 < hits["e", "b", row] < 258 for row in range(1, 8))


def test_study_by_brute_force(spark):
    rng = np.random.default_rng(3)
    values = {t: (rng.normal(10 + t, 1, 40)).tolist() for t in (0, 1)}
    df = spark.createDataFrame([(True, f"t{t}", v, i) for t, vs in values.items() for i, v in enumerate(vs)], "excl boolean, tag string, walltime double, id int")
    experiments = spark.createDataFrame([("change", True, "t0", "t1"), ("control", True, "t0", "t0")], "experiment string, excl boolean, group_a string, group_b string")
    sizes = [2, 3, 10, 40, 41]
    got = statistics.anova_power(df, experiments, ["excl"], "tag", "walltime", [F.col("id")], sizes, 5, seed=1).collect()
    sized = experiments.withColumns({"n_a": F.lit(40).cast("long"), "n_b": F.lit(40).cast("long")})
    picks = {}
    for r in statistics.sampling_design(sized, ["experiment", "excl"], sizes, 5, 1).collect():
        picks.setdefault((r["experiment"], r["rep"], r["side"]), {})[r["place"]] = r["row_no"] - 1
    assert len(got) == 2 * 5 * 4
    for r in got:
        a, b = (
            np.array([values[t][picks[r["experiment"], r["rep"], side][p]] for p in range(1, r["sample_size"] + 1)])
            for side, t in (("a", 0), ("b", 1 if r["experiment"] == "change" else 0))
        )
        assert (r["mean_a"], r["mean_b"]) == (pytest.approx(a.mean()), pytest.approx(b.mean()))
        k = r["sample_size"]
        f = k / 2 * (a.mean() - b.mean()) ** 2 / ((a.var() + b.var()) * k / (2 * k - 2))
        assert r["f"] == pytest.approx(f, rel=1e-9, abs=1e-12)
    assert {r["f"] for r in got if r["experiment"] == "control" and r["sample_size"] == 40} != set()


def test_bootstrap_weights_by_brute_force(spark):
    rows = [("k", i, float(i % 7) + 0.5 * i) for i in range(60)] + [("one", 0, 4.0), ("none", 0, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double").repartition(5)
    got = {r["k"]: (r["mean"], r["low"], r["high"]) for r in statistics.bootstrap_band(df, ["k"], "v", ["id"], draws=300, seed=5).collect()}
    steps, means = statistics.poisson_steps(), []
    for a, b in statistics.draw_factors(300, 5):
        weights = [sum((a * int(hashlib.md5(f"k/{i}".encode()).hexdigest()[:7], 16) + b) % statistics.PRIME > s for s in steps) for i in range(60)]
        means.append(np.average([v for _, _, v in rows[:60]], weights=weights))
    assert got["k"] == (pytest.approx(np.mean([v for _, _, v in rows[:60]])), *(pytest.approx(np.quantile(means, q)) for q in (0.05, 0.95)))
    assert got["one"] == (4.0, 4.0, 4.0) and set(got) == {"k", "one"}
    assert abs(np.diff([-1, *steps, statistics.PRIME - 1]) / statistics.PRIME @ np.arange(len(steps) + 1) - 1) < 1e-6


def test_bootstrap_band_covers_the_mean(spark):
    df = spark.createDataFrame([("k", float(i % 10)) for i in range(100)], "k string, v double")
    r = statistics.bootstrap_band(df, ["k"], "v", draws=200).first()
    assert r["mean"] == 4.5 and 3.8 < r["low"] < 4.5 < r["high"] < 5.2


def test_kruskal_brute_force(spark):
    groups = {"a": [1.0, 2.0, 2.0, 5.0], "b": [2.0, 3.0, 8.0], "c": [0.5, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    pooled = sorted(v for vs in groups.values() for v in vs)
    n = len(pooled)
    rank = {v: np.mean([i + 1 for i, x in enumerate(pooled) if x == v]) for v in pooled}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    h /= 1 - sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled)) / (n**3 - n)
    assert statistics.kruskal(df, [], "g", "v").first()["h"] == pytest.approx(h)


@pytest.mark.parametrize("dof", [1, 2, 3, 7, 40, 301])
def test_chi_square_tail(dof):
    x = np.array([0.0, 1e-6, 0.3, dof / 2, dof, dof * 1.5, dof * 2.0 + 30])
    got = tails.gamma_upper(np.full(len(x), dof / 2), x / 2)
    for value, q in zip(x, got, strict=True):
        y = value / 2
        if dof % 2 == 0:
            want = sum(math.exp(i * math.log(y) - y - math.lgamma(i + 1)) if y else float(i == 0) for i in range(dof // 2))
        else:
            want = math.erfc(math.sqrt(y)) + sum(
                math.exp((i + 0.5) * math.log(y) - y - math.lgamma(i + 1.5)) if y else 0.0 for i in range(dof // 2)
            )
        assert q == pytest.approx(want, rel=1e-10, abs=1e-14)


def test_kruskal_decision_steps_down(spark):
    rng, rows = np.random.default_rng(8), []
    shifts = {"far": 3.0, "near": 0.9, "same": 0.0, "other": 0.0}
    for name, shift in shifts.items():
        rows += [(name, level, float(v)) for level in (0, 1) for v in rng.normal(shift * level, 1, 25)]
    rows += [("flat", level, 1.0) for level in (0, 1)] + [("single", 0, float(v)) for v in range(5)]
    df = spark.createDataFrame(rows, "test string, level int, v double").repartition(4)
    got = {r["test"]: r for r in statistics.kruskal_decision(df, ["test"], "level", "v", alpha=0.05).collect()}
    p = sorted((r["p_value"], t) for t, r in got.items() if r["p_value"] is not None)
    assert [t for _, t in p[:1]] == ["far"] and got["flat"]["p_value"] is None and got["single"]["p_value"] is None
    rejected = set()
    for left, (value, t) in zip(range(len(p), 0, -1), p, strict=True):
        if value > 0.05 / left:
            break
        rejected.add(t)
    assert {t for t, r in got.items() if r["reject"]} == rejected and "far" in rejected and "same" not in rejected
    for value, t in p:
        assert value == pytest.approx(math.erfc(math.sqrt(got[t]["h"] / 2)), rel=1e-9)


def test_histogram_last_bin_and_flat_group(spark):
    rows = [("r", float(v)) for v in range(12)] + [("flat", 2.0)] * 3
    got = {(r["k"], r["bin"]): r["items"] for r in aggregates.histogram(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got[("r", 11)] == 2 and got[("r", 1)] == 1 and got[("flat", 1)] == 3 and max(b for _, b in got) == 11


def test_geometric_mean_and_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 0.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    got = {r["k"]: r["g"] for r in df.groupBy("k").agg(aggregates.geometric_mean(F.col("v")).alias("g")).collect()}
    assert got["a"] == pytest.approx(2.0) and got["b"] == 0.0
    scaled = {(r["k"], r["v"]): r["scaled"] for r in aggregates.minmax_scale(df, ["k"], "v").collect()}
    assert scaled[("a", 4.0)] == 1.0 and scaled[("c", 3.0)] is None


def test_neighbours(spark):
    df = spark.createDataFrame([("k", t) for t in ("c", "a", "b", "a")] + [("one", "a")], "k string, tag string")
    got = sorted(tuple(r) for r in statistics.neighbours(df, ["k"], "tag").select("k", "group_a", "group_b").collect())
    assert got == [("k", "a", "b"), ("k", "b", "c")]


def test_paired_rows_are_cut_to_the_shorter_group(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0), ("y", 9.0), ("y", 8.0)], "g string, v double")
    got = sorted(tuple(r) for r in statistics.paired_rows(df, [], "g", ("x", "y"), "v", [F.col("v")]).collect())
    assert got == [(1, 1.0, 8.0), (2, 2.0, 9.0)]
