"""Exact percentiles per group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.session import stored
from runledger.sizing import keyed_join, quoted

# The rank of a value that a sketch of this size gives is off by a standard deviation of about 0.1 % of the values;
# SLACK on either side is ten of these.
SKETCH, SLACK = 1024, 0.01
# Values of a group that are counted one by one; brackets that hold more are narrowed by further sketches.
COUNTED = 1 << 22
GRID = 64  # steps of a further sketch
LEAST, MOST = float("-inf"), float("nan")


def group_percentiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per group with one column per probability (linear interpolation; nulls are left out)."""
    return aggregate_with_percentiles(df, keys, [], value, probabilities)


def aggregate_with_percentiles(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    value: str,
    probabilities: dict[str, float],
    sketch: int = SKETCH,
    counted: int = COUNTED,
) -> DataFrame:
    """One row per group: named aggregates, and one percentile column per probability.

    Spark's ``percentile`` keeps the distinct values of a group in one task. Here a first pass gives the aggregates
    and a quantile sketch of each group, with map-side combining; the sketch brackets the wanted ranks. A second pass
    counts each value within a bracket, and all values between two brackets together; the ranks follow by adding up.
    Groups of up to ``sketch`` values are one bracket. Where brackets hold more than ``counted`` values, further
    sketches narrow them first. The result is exact. NaN is the largest value, as Spark sorts it. A group without a
    value has null percentiles.
    """
    columns = [F.col(quoted(k)) for k in keys]
    v = F.col(quoted(value)).cast("double")
    wanted = sorted(set(probabilities.values()))
    # A sketch takes no NaN; for bracketing it may stand with the infinite ones.
    first = df.groupBy(*columns).agg(
        *aggregates,
        F.count(v).alias("__total"),
        F.kll_sketch_agg_double(F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v), F.lit(sketch)).alias("__sketch"),
    )
    edges = [x for p in wanted for x in (max(p - SLACK, 0.0), min(p + SLACK, 1.0))]
    large, found = F.col("__total") > sketch, F.kll_sketch_get_quantile_double("__sketch", F.array(*map(F.lit, edges)))
    kept = [F.col(quoted(c)) for c in first.columns if c not in ("__total", "__sketch")]
    bounded = first.select(*kept, "__total", F.when(large, found).alias("__found"))
    low = [F.when(large & F.lit(p > SLACK), F.col("__found")[2 * i]).otherwise(LEAST) for i, p in enumerate(wanted)]
    high = [F.when(large & F.lit(p < 1 - SLACK), F.col("__found")[2 * i + 1]).otherwise(MOST) for i, p in enumerate(wanted)]
    # Written once: sketches draw at random, and a task that is run again must meet the same brackets.
    table = stored(bounded.select(*kept, "__total", F.array(*low).alias("__low"), F.array(*[_open(h) for h in high]).alias("__high")), "sketches")

    rows = df.select(*columns, v.alias("__v")).where("__v is not null")
    brackets = table.select(*columns, "__total", "__low", "__high").where("__total > 0")
    share = min(1.0, 2 * SLACK * len(wanted))
    widest = (table.agg(F.max("__total")).first()[0] or 0) * share
    while widest > counted:
        brackets = stored(_narrowed(rows, brackets, keys, wanted, sketch), "brackets")
        before, widest = widest, brackets.agg(F.max("__inside")).first()[0]
        brackets = brackets.drop("__inside")
        if widest > before / 2:  # many equal values, which are counted as one
            break
    table = keyed_join(table, _counted(rows, brackets, keys, wanted), keys, "left")
    result = []
    for name, p in probabilities.items():
        place, at = F.lit(p) * (F.col("__total") - 1), wanted.index(p)
        below, above = F.col("__at")[F.lit(2 * at)], F.col("__at")[F.lit(2 * at + 1)]
        # The weights Spark's own percentile uses.
        mixed = (F.ceil(place) - place) * below + (place - F.floor(place)) * above
        result.append(F.when((F.floor(place) == F.ceil(place)) | (below == above), below).otherwise(mixed).alias(name))
    return table.select(*kept, *result)


def _open(high: Column) -> Column:
    """An upper bound; above infinity there is NaN."""
    return F.when(high == float("inf"), MOST).otherwise(high)


def _ranks(wanted: list[float]) -> list[Column]:
    """The ranks from 0 that the probabilities need: the lower and the upper one of each."""
    places = [F.lit(p) * (F.col("__total") - 1) for p in wanted]
    return [rank for place in places for rank in (F.floor(place), F.ceil(place))]


def _met(rows: DataFrame, brackets: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Values with their segment: 2 k + 1 within the bracket k, 2 k below it and above the one before.

    Bounds ascend with k, so segments ascend with the values, also where brackets overlap.
    """
    v, segment = F.col("__v"), F.lit(2 * count)
    for k in reversed(range(count)):
        inside = F.when(v >= F.col("__low")[k], 2 * k + 1).otherwise(2 * k)
        segment = F.when(v <= F.col("__high")[k], inside).otherwise(segment)
    return keyed_join(rows, brackets, keys).withColumn("__segment", segment)


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: list[str], wanted: list[float], sketch: int) -> DataFrame:
    """Narrower brackets, by sketches of the values within; ``__inside`` tells about how many they hold together."""
    columns = [F.col(quoted(k)) for k in keys]
    v = F.when(F.col("__segment") % 2 == 1, F.when(F.isnan("__v"), F.lit(float("inf"))).otherwise(F.col("__v")))
    parts = _met(rows, brackets, keys, len(wanted)).groupBy(*columns, "__total", "__segment").agg(
        F.count(F.lit(1)).alias("__n"), F.kll_sketch_agg_double(v, F.lit(sketch)).alias("__sketch")
    )
    upto = Window.partitionBy(*columns).orderBy("__segment").rowsBetween(Window.unboundedPreceding, 0)
    start, n = F.col("__upto") - F.col("__n"), F.col("__n")
    own = F.filter(F.array(*_ranks(wanted)), lambda r: (r >= start) & (r < F.col("__upto")))
    placed = parts.withColumn("__upto", F.sum("__n").over(upto)).where("__segment % 2 = 1").withColumn("__own", own)
    steps = F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    low_step = F.floor(((F.array_min("__own") - start) / n - SLACK) * GRID).cast("int")
    high_step = F.ceil(((F.array_max("__own") - start + 1) / n + SLACK) * GRID).cast("int")
    cut = placed.where(F.size("__own") > 0).select(
        *columns, "__total", "__n", steps.alias("__steps"), low_step.alias("__a"), high_step.alias("__b"), F.floor(F.col("__segment") / 2).alias("__k")
    )
    inside = F.least(n, F.ceil(n * (F.col("__b") - F.col("__a")) / GRID))
    bound = F.struct(
        "__k",
        F.when(F.col("__a") > 0, F.get("__steps", F.col("__a"))).alias("low"),
        F.when(F.col("__b") < GRID, _open(F.get("__steps", F.col("__b")))).alias("high"),
    )
    new = cut.groupBy(*columns, "__total").agg(F.collect_list(bound).alias("__new"), F.sum(inside).alias("__inside"))
    joined = keyed_join(brackets.drop("__total"), new, keys)
    # A bracket without ranks of its own shrinks to its upper bound. Ends that did not move stay.
    lows, highs = [], []
    for k in range(len(wanted)):
        mine = F.filter("__new", lambda b: b["__k"] == k)
        lows.append(F.when(F.size(mine) == 0, F.col("__high")[k]).otherwise(F.coalesce(F.get(mine, F.lit(0))["low"], F.col("__low")[k])))
        highs.append(F.coalesce(F.get(mine, F.lit(0))["high"], F.col("__high")[k]))
    return joined.select(*columns, "__total", F.array(*lows).alias("__low"), F.array(*highs).alias("__high"), "__inside")


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """For each group a map ``__at``: 2 i and 2 i + 1 for the values of the lower and upper rank of probability i."""
    columns = [F.col(quoted(k)) for k in keys]
    own = F.when(F.col("__segment") % 2 == 1, F.col("__v")).alias("__v")
    counts = _met(rows, brackets, keys, len(wanted)).groupBy(*columns, "__total", "__segment", own).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*columns).orderBy("__segment", "__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("__upto", F.sum("__n").over(upto))
    here = [
        F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n")), F.struct(F.lit(i).alias("key"), F.col("__v").alias("value")))
        for i, rank in enumerate(_ranks(wanted))
    ]
    found = placed.select(*columns, "__segment", F.explode(F.array_compact(F.array(*here))).alias("__end"))
    # A rank outside the brackets is beyond all odds; it must not pass for a null.
    missed = F.raise_error(F.lit("a sketch missed a rank: run the query again"))
    whole = F.when(F.count_if(F.col("__segment") % 2 == 0) > 0, missed).otherwise(F.map_from_entries(F.collect_list("__end")))
    return found.groupBy(*columns).agg(whole.alias("__at"))
