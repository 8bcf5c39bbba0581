"""Mixing sources to target weights: hierarchical budgets and token prefixes of seeded epochs.

The token budget goes down a tree of levels. Each node deals its budget to its children by weight; a child takes
no more than its subtree can give (tokens times the most epochs), and what it leaves goes to its siblings. Only
what a whole subtree cannot use reaches the siblings of its parent. A leaf then takes its documents epoch by
epoch, each epoch in an order of its own, and the last epoch up to the token that uses up the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runledger.llm.common import stored

# Parts of a leaf's order of an epoch that are summed up before single documents are looked at.
PARTS = 1024


def n_words(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII blanks; none in a null text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """Where a document stands in an epoch: 60 bits of a digest of seed, epoch and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("-"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def level_budgets(nodes: DataFrame, parents: list[str], budget: str = "budget") -> DataFrame:
    """Deals each parent's budget to its children: adds ``share``.

    ``nodes`` has for each child ``weight``, ``room`` (most it can use) and its parent's budget. Children are
    filled in order of room for each unit of weight: as long as a child's room is no more than its part of what is
    left, it gets its room; all others split the rest by weight. Where no child has weight, they count alike.
    """
    group = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    weighed = nodes.withColumn("total", F.sum("weight").over(group)).withColumn(
        "weight", F.when(F.col("total") > 0, F.col("weight")).otherwise(F.lit(1.0))
    )
    weighed = weighed.withColumn("fill", F.when(F.col("weight") > 0, F.col("room") / F.col("weight")))
    # Children of weight 0 come last, and get only what the others leave.
    order = group.orderBy(F.col("fill").asc_nulls_last(), *[c for c in nodes.columns if c not in ("weight", "room", budget)])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    parts = (
        weighed.withColumn("used", F.coalesce(F.sum("room").over(before), F.lit(0)).cast("double"))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("heavy", F.sum(F.when(F.col("weight") > 0, F.col("room")).otherwise(0)).over(group).cast("double"))
    )
    left = F.col(budget) - F.col("used")
    parts = parts.withColumn("filled", (F.col("fill").isNotNull()) & (F.col("room") * F.col("open") <= left * F.col("weight")))
    # "filled" holds for a first run of children; the first open one gives the level of all open ones.
    open_level = F.when(~F.col("filled") & F.col("fill").isNotNull(), left / F.col("open"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.withColumn("level", F.first(open_level, True).over(whole))
    rest = F.least(F.col("room").cast("double"), F.greatest(left, F.lit(0.0)))
    share = (
        F.when(F.col("fill").isNull(), F.when(F.col("heavy") < F.col(budget), rest).otherwise(F.lit(0.0)))
        .when(F.col("level").isNull() | (F.col("fill") <= F.col("level")), F.col("room").cast("double"))
        .otherwise(F.col("level") * F.col("weight"))
    )
    return parts.withColumn("share", share).drop("total", "fill", "used", "open", "heavy", "filled", "level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column) -> DataFrame:
    """Budget of each leaf in whole tokens: adds ``take``.

    ``leaves`` has the level columns, ``tokens`` and ``room``; ``weights`` gives a weight for each level in terms of
    the level columns up to it. ``budget`` is computed over all leaves, as ``sum(tokens)``.
    """
    root = leaves.agg(budget.cast("double").alias("share"))
    above = root
    for depth, level in enumerate(levels):
        own = levels[: depth + 1]
        weight = F.greatest(F.coalesce(weights[level].cast("double"), F.lit(0.0)), F.lit(0.0))
        nodes = leaves.groupBy(*own).agg(F.sum("room").alias("room")).withColumn("weight", weight)
        if depth == 0:
            top = above.select(F.col("share").alias("budget"))
            nodes = nodes.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one").drop("one")
        else:
            given = above.select(*[F.col(c).alias(f"up_{c}") for c in levels[:depth]], F.col("share").alias("budget"))
            same = F.lit(True)
            for c in levels[:depth]:
                same = same & F.col(c).eqNullSafe(F.col(f"up_{c}"))
            nodes = nodes.join(given, same).drop(*[f"up_{c}" for c in levels[:depth]])
        above = level_budgets(nodes, levels[:depth]).select(*own, "share")
    given = above.select(*[F.col(c).alias(f"up_{c}") for c in levels], F.floor(F.col("share") + 1e-6).alias("take"))
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"up_{c}"))
    return leaves.join(given, same).drop(*[f"up_{c}" for c in levels])


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, Column],
    share: float,
    epochs: int = 2,
    seed: int = 7,
    doc_id: str = "doc_id",
    n_tokens: Column | None = None,
    text: str = "text",
) -> DataFrame:
    """One row for each document and epoch it is taken in: ``doc_id``, the level columns, ``epoch`` (from 0),
    ``n_tokens`` and ``taken`` (tokens used: all, or fewer for the one document where a leaf's budget ends).

    ``share`` is the budget as a part of all tokens; it may go beyond 1, up to ``epochs`` times what a leaf has.
    A leaf with a third of all rows is split in ``PARTS`` by the order of its epoch: parts are summed up first,
    and only the part where the budget ends is numbered document by document.

    Null levels are levels of their own. Documents without tokens are never taken. Equal places (repeated rows)
    are ordered by id and size; documents alike in both may stand for each other. An empty table gives no rows.
    """
    names = list(levels)
    size = n_words(docs[f"`{text}`"]) if n_tokens is None else n_tokens
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), *[c.alias(n) for n, c in levels.items()], size.alias("n_tokens"))
    # Texts are read and counted once; everything below looks at ids, levels and sizes only.
    rows = stored(rows.filter("n_tokens > 0"), "sizes")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.withColumn("room", F.col("tokens") * epochs)
    budgets = leaf_budgets(leaves, names, weights, F.sum("tokens") * share)
    budgets = budgets.select(*[F.col(c).alias(f"leaf_{c}") for c in names], "tokens", "take")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"leaf_{c}"))
    # Leaves are few; Spark sends them along if they are small, and splits hot leaves if not.
    placed = rows.join(budgets, same).drop(*[f"leaf_{c}" for c in names])
    turns = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("take") / F.col("tokens")) - 1).cast("int")))
    placed = placed.filter("take > 0").withColumn("epoch", turns)
    placed = placed.withColumn("place", place(seed, F.col("epoch"), F.col("doc_id")))
    placed = placed.withColumn("part", F.shiftright("place", 50).cast("int"))
    left = F.col("take") - F.col("epoch") * F.col("tokens")
    whole = placed.filter(left >= F.col("tokens")).withColumn("taken", F.col("n_tokens"))
    cut = placed.filter(left < F.col("tokens")).withColumn("left", left)
    sums = cut.groupBy(*names, "part").agg(F.sum("n_tokens").alias("sum"))
    before = W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"leaf_{c}") for c in names], F.col("part").alias("leaf_part"), "sum", "before")
    cut = cut.join(sums, same & (F.col("part") == F.col("leaf_part"))).drop(*[f"leaf_{c}" for c in names], "leaf_part")
    inside = cut.filter(F.col("before") + F.col("sum") <= F.col("left")).withColumn("taken", F.col("n_tokens"))
    edge = cut.filter((F.col("before") + F.col("sum") > F.col("left")) & (F.col("before") < F.col("left")))
    run = W.partitionBy(*names).orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    edge = edge.withColumn("taken", F.least(F.col("n_tokens"), F.col("left") - F.col("start"))).filter("taken > 0")
    wanted = ["doc_id", *names, "epoch", "n_tokens", "taken"]
    return whole.select(*wanted).union(inside.select(*wanted)).union(edge.select(*wanted))
