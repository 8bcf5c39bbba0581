"""Hard negatives for contrastive training, by the threshold algorithm over sorted lists.

Candidates are dealt in blocks. A block keeps one list of its rows per dimension, sorted by component. For an
anchor the lists are read from the end where the anchor's component is negative, else from the start, some entries
of every list at a time. Each row met is scored at once (an integer inner product). No row still unseen can score
more than the anchor's product with the components last read, so reading stops once this threshold is strictly
below the ``k``-th score of every window: rows of equal score are then all seen, and ties come out by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCALE = 256
LARGEST = 1 << 18  # components must be smaller, so that sums of products of up to 1,024 of them fit a long
BLOCK_ROWS = 8_192
FIRST_STEP = 16  # entries of each list read at first; each later step reads twice as many
LEAST, MOST = -(1 << 62), 1 << 62


class Block:
    """Rows with their sorted lists. Rows of one block have vectors of one length."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: list[str], vectors: np.ndarray):
        self.ids, self.keys = ids, keys
        names, self.labels = np.unique(np.array(labels, object).astype(str), return_inverse=True)
        self.names = {name: at for at, name in enumerate(names.tolist())}
        self.vectors = np.ascontiguousarray(vectors)
        self.lists = np.ascontiguousarray(np.argsort(-self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.size = int(np.abs(self.vectors).max(initial=0))
        # Products of doubles are exact up to 2^53, and faster than those of integers.
        self.doubles = self.vectors.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.size * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 1 << 53:
            return (self.doubles[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.vectors[rows] * anchor).sum(axis=1)

    def best(
        self, anchor: np.ndarray, anchor_id: int, label: str, same: bool, lows: np.ndarray, highs: np.ndarray, k: int
    ) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Rows and scores of the first ``k`` of each window, and how many rows were looked at."""
        n = len(self.ids)
        fits = (self.labels == self.names.get(label, -1)) == same
        fits &= self.ids != anchor_id
        used = np.flatnonzero(anchor)
        weights, lists = anchor[used], self.lists[used]
        down = weights < 0
        seen, score = np.zeros(n, bool), np.zeros(n, np.int64)
        closed = lows > highs
        depth, step, read = 0, FIRST_STEP, 0
        while not closed.all() and depth < n and read < n:
            end = min(n, depth + step)
            met = np.zeros(n, bool)
            met[lists[~down, depth:end]] = True
            met[lists[down, n - end : n - depth]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            score[new] = self.scores(new, anchor)
            read += len(new)
            last = np.where(down, lists[:, n - end], lists[:, end - 1])
            threshold = int((weights * self.vectors[last, used]).sum()) if len(used) else LEAST
            depth, step = end, 2 * step
            have = score[seen & fits]
            for at in np.flatnonzero(~closed).tolist():
                inside = have[(have >= lows[at]) & (have <= highs[at])]
                kth = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else lows[at]
                closed[at] = threshold < kth
        if not len(used):
            seen[:] = True  # all scores are zero
        rows = np.flatnonzero(seen & fits)
        out = []
        for low, high in zip(lows, highs, strict=True):
            inside = rows[(score[rows] >= low) & (score[rows] <= high)]
            if len(inside) > k:
                inside = inside[score[inside] >= np.partition(score[inside], len(inside) - k)[len(inside) - k]]
            inside = inside[np.lexsort((self.keys[inside], self.ids[inside], -score[inside]))][:k]
            out.append((inside, score[inside]))
        return out, read


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor empty, all components finite and below ``LARGEST`` in size."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def _search(candidates: DataFrame, anchors: DataFrame, same: bool, k: int, block_rows: int) -> DataFrame:
    """The first ``k`` rows of each window of each anchor in each block: a task holds one block, anchors stream past.

    ``candidates``: id, key, label, vector; ``anchors`` also have lows and highs, the bounds of their windows. Blocks
    hold vectors of one length, and of one label where only rows of the same label are asked for.
    """
    group = [F.col("label") if same else F.lit(None).cast("string"), F.size("vector")]
    own = candidates.select(group[0].alias("group"), group[1].alias("length"), "id", "key", "label", "vector")
    sizes = own.groupBy("group", "length").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    ask = anchors.select(group[0].alias("group"), group[1].alias("length"), "id", "key", "label", "vector", "lows", "highs")

    def dealt(rows: DataFrame) -> DataFrame:
        size = sizes.select(F.col("group").alias("of"), F.col("length").alias("long"), "parts")
        return rows.join(size, F.col("group").eqNullSafe(F.col("of")) & (F.col("length") == F.col("long")))

    none = F.lit(None).cast("array<long>")
    columns = ["group", "length", "part", "asks", "id", "key", "label", "vector", "lows", "highs"]
    held = dealt(own).select(
        "*", F.pmod("key", "parts").cast("int").alias("part"), F.lit(0).alias("asks"), none.alias("lows"), none.alias("highs")
    ).select(columns)
    asked = dealt(ask).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks")).select(columns)
    place = ["group", "length", "part"]
    ordered = held.union(asked).repartition(*place).sortWithinPartitions(*place, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            asks, ids, keys = (batch.column(i).to_numpy() for i in (3, 4, 5))
            labels, length = batch.column(6).to_pylist(), batch.column(1).to_pylist()
            flat, starts = batch.column(7).flatten().to_numpy(), np.concatenate(([0], np.cumsum(length)))
            lows, highs = batch.column(8).to_pylist(), batch.column(9).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for row in range(batch.num_rows):
                if places[row] != at:
                    at, held, block = places[row], [], None
                vector = flat[starts[row] : starts[row + 1]]
                if not asks[row]:
                    held.append((ids[row], keys[row], labels[row], vector.copy()))
                    continue
                if block is None and held:
                    i, h, l, v = zip(*held, strict=True)
                    block, held = Block(np.array(i), np.array(h), list(l), np.stack(v)), []
                if block is None:
                    continue
                bounds = np.array(lows[row], np.int64), np.array(highs[row], np.int64)
                for number, (rows, scores) in enumerate(block.best(vector, int(ids[row]), labels[row], same, *bounds, k)[0]):
                    for to, values in zip(out, (np.full(len(rows), ids[row]), np.full(len(rows), keys[row]), np.full(len(rows), number), block.ids[rows], block.keys[rows], scores), strict=True):
                        to.append(values)
            if out[0]:
                arrays = [pa.array(np.concatenate(x), pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "anchor_key", "number", "id", "key", "score"])

    found = ordered.mapInArrow(run, "anchor_id long, anchor_key long, number int, id long, key long, score long")
    first = W.partitionBy("anchor_id", "anchor_key", "number").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine(
    table: DataFrame,
    anchors: Column,
    label: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Gives ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.
    A score is the inner product of the vectors' components times 256, rounded down; higher ones come first, ties by
    smaller id. ``anchors`` tells which rows are anchors, ``label`` gives a row's label; both may use all columns.

    Rows without id or label take no part, nor vectors that are null, empty, or hold a null, a non-finite component
    or one of 2^18 or more in size (sums might not fit). Vectors of different lengths are not compared. Equal rows
    count once; other rows under one id are rows of their own, but none is compared with an anchor of its id. A
    positive score below zero has no negatives. Other columns, whatever their names, play no part.
    """
    numbers = F.transform(F.col("vector"), lambda x: F.floor(x * SCALE))
    rows = table.select(
        table[f"`{vec_id}`"].cast("long").alias("id"),
        label.cast("string").alias("label"),
        table[f"`{vector}`"].cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = rows.select("id", "label", numbers.alias("vector"), "anchor")
    rows = rows.select("id", F.xxhash64("id", "label", "vector").alias("key"), "label", "vector", "anchor")
    rows = rows.groupBy("id", "key", "label", "vector").agg(F.max("anchor").alias("anchor"))
    candidates, asked = rows.drop("anchor"), rows.filter("anchor").drop("anchor")
    everything = asked.withColumn("lows", F.array(F.lit(LEAST))).withColumn("highs", F.array(F.lit(MOST)))
    near = _search(candidates, everything, True, positives, block_rows)
    # At most ``positives`` windows an anchor.
    window = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = near.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    bounds = [
        F.transform("windows", lambda w: F.ceil(w["positive_score"] * low / F.lit(100).cast("decimal(3)")).cast("long")).alias("lows"),
        F.transform("windows", lambda w: F.floor(w["positive_score"] * high / F.lit(100).cast("decimal(3)")).cast("long")).alias("highs"),
    ]
    own = F.col("id") == F.col("anchor_id")
    windows = asked.join(near, own & (F.col("key") == F.col("anchor_key"))).select("id", "key", "label", "vector", "windows", *bounds)
    far = _search(candidates, windows, False, negatives, block_rows)
    return far.join(near, ["anchor_id", "anchor_key"]).select(
        "anchor_id",
        F.col("windows")[F.col("number")]["positive_id"].alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("windows")[F.col("number")]["positive_score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
