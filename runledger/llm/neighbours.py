"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced clustering of a bounded sample. A vector goes to the list of its nearest centroid
and, near a boundary, also to the lists of others that are nearly as close. The centroids, not the vectors, are in
memory: a graph over them is searched greedily for the lists of a vector. A query looks at the lists nearest to it,
up to a number and up to a ratio of their distance to that of a near one. Number and ratio are fitted: some queries are
answered exactly first, and both are the smallest at which enough of the true neighbours are in the lists looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from runledger.llm.common import stored

LIST_SIZE = 50  # vectors a list aims at, before copies
MOST_LISTS = 4_096
SAMPLE = 16  # vectors that centroids are fitted on, for each list
LIST_ROWS = 4_096  # vectors of a list that one task scans at a time
COPIES = 4  # lists that a boundary vector is in, at most
BOUNDARY = 1.15  # distance to a further centroid, over that to the nearest
BASE = 4  # a query's distances are compared with that to this nearest centroid; the first is no measure near copies
FITTED = 256  # queries that are answered exactly, to fit what the others look at
RECALL = 0.965  # share of their neighbours that must be in the lists looked at
BY_NUMBER = 0.5  # of the neighbours given up, those that the number of lists leaves out; the ratio leaves out the rest
DEGREE = 24
OPENED = 4  # centroids that one step of a search opens
BLOCK = 64  # queries that are compared with a list at a time


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, near enough for choosing lists."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _split_even(points: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index lists of about equal length: halves along the axis between two means, again and again."""
    if parts <= 1 or len(points) < 2:
        return [np.arange(len(points))]
    left = parts // 2
    ends = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(6):
        side = _distances(points, ends)
        order = np.argsort(side[:, 0] - side[:, 1], kind="stable")
        cut = max(1, min(len(points) - 1, round(len(points) * left / parts)))
        ends = np.stack([points[order[:cut]].mean(0), points[order[cut:]].mean(0)])
    out = []
    for half, count in ((order[:cut], left), (order[cut:], parts - left)):
        out += [half[x] for x in _split_even(points[half], count, rng)]
    return out


@dataclass
class CentroidGraph:
    """Centroids with links to near ones, for greedy search from a few entry points."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, lists: int, seed: int = 5) -> CentroidGraph:
        rng = np.random.default_rng(seed)
        parts = _split_even(points, max(1, min(lists, len(points))), rng)
        centroids = np.stack([points[p].mean(0) for p in parts if len(p)])
        between = _distances(centroids, centroids)
        near = np.argsort(between, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        # Some random links keep the graph in one piece.
        far = rng.integers(0, len(centroids), (len(centroids), 4))
        entries = rng.choice(len(centroids), min(8, len(centroids)), replace=False)
        return cls(centroids, np.concatenate([near, far], axis=1), entries)

    def nearest(self, vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``count`` nearest centroids of each vector, nearest first.

        All vectors step at once: a step opens the nearest unopened centroids in each vector's beam, and the beam
        keeps the nearest of those and their links. Places without a centroid have an infinite distance.
        """
        total = len(self.centroids)
        count = min(count, total)
        beam = min(total, max(32, count + count // 4 + 16))
        norms = (self.centroids**2).sum(1)
        seen = np.zeros((len(vectors), total), bool)
        ids = np.full((len(vectors), beam), -1)
        found = np.full((len(vectors), beam), np.inf, np.float32)
        opened = np.ones((len(vectors), beam), bool)
        rows = np.arange(len(vectors))

        def look(who: np.ndarray, at: np.ndarray) -> None:
            at = np.sort(at, axis=1)
            fresh = ~seen[who[:, None], at]
            fresh[:, 1:] &= at[:, 1:] != at[:, :-1]
            r, c = np.nonzero(fresh)
            w, k = who[r], at[r, c]
            seen[w, k] = True
            new = np.full(at.shape, np.inf, np.float32)
            new[r, c] = norms[k] - 2 * np.einsum("ij,ij->i", vectors[w], self.centroids[k])
            far = np.concatenate([found[who], new], axis=1)
            keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            found[who] = np.take_along_axis(far, keep, 1)
            ids[who] = np.take_along_axis(np.concatenate([ids[who], at], axis=1), keep, 1)
            opened[who] = np.take_along_axis(np.concatenate([opened[who], ~fresh], axis=1), keep, 1)

        look(rows, np.tile(self.entries, (len(vectors), 1)))
        active, width = rows, min(OPENED, beam)
        while len(active):
            worth = np.where(opened[active], np.inf, found[active])
            pick = np.argpartition(worth, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(worth, pick, 1)
            going = np.isfinite(value).any(1)
            active, pick, value = active[going], pick[going], value[going]
            if len(active):
                opened[active[:, None], pick] = True
                chosen = ids[active[:, None], pick]
                # Where fewer are left to open, the nearest stands in for the others.
                chosen = np.where(np.isfinite(value), chosen, np.take_along_axis(chosen, value.argmin(1)[:, None], 1))
                look(active, self.links[chosen].reshape(len(active), -1))
        order = np.argsort(found, axis=1, kind="stable")[:, :count]
        squared = np.maximum(np.take_along_axis(found, order, 1) + (vectors**2).sum(1)[:, None], 0)
        return np.take_along_axis(ids, order, 1), np.sqrt(squared)

    def lists(self, vectors: np.ndarray, most: int, ratio: float, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids of each vector, and which of them are at most ``ratio`` times as far as the
        one at place ``base``."""
        numbers, far = self.nearest(vectors, most)
        unit = far[:, min(base, far.shape[1]) - 1][:, None]
        return numbers, np.isfinite(far) & (far <= np.maximum(unit * ratio, unit + 1e-6))


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy().reshape(len(column), -1).astype(kind)


def fit_centroids(vectors: DataFrame, count: int, lists: int | None = None) -> CentroidGraph:
    """Graph of balanced centroids from about ``SAMPLE`` rows (``vec_id``, ``vector``) a list, picked by a hash.

    Without ``lists``, there is one for every ``LIST_SIZE`` of the ``count`` vectors, up to ``MOST_LISTS``; so the
    sample has a bound.
    """
    lists = lists or min(MOST_LISTS, max(1, count // LIST_SIZE))
    sample = SAMPLE * lists
    unit = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) / float(1 << 30)
    picked = vectors.filter(unit < min(1.0, sample / count)).select("vector").limit(2 * sample).toArrow()
    if not picked.num_rows:
        picked = vectors.select("vector").limit(1).toArrow()
    points = _matrix(picked.column(0).combine_chunks())
    # Copies of one vector would draw the centroids together.
    points = np.unique(points, axis=0)
    return CentroidGraph.build(points, lists)


def fit_probes(vectors: DataFrame, asked: DataFrame, graph, k: int, recall: float = RECALL) -> tuple[int, float]:
    """How many lists a query looks at, and up to which ratio of distances.

    ``FITTED`` queries, the first by a hash, are compared with all vectors; each of their true neighbours stands in
    lists, the nearest of which has a rank and a ratio for the query. Of these neighbours ``recall`` are reached.
    """
    picked = asked.orderBy(F.xxhash64("query_id", "vector"), "query_id").limit(FITTED).toArrow()
    if not picked.num_rows:
        return 1, 1.0
    numbers, queries = picked.column(0).to_numpy(), _matrix(picked.column(1).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, near, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.zeros((0, queries.shape[1]), np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows, LIST_ROWS):
                part = batch.slice(begin, LIST_ROWS)
                ids, points = part.column(0).to_numpy(), _matrix(part.column(1))
                order = np.argsort(ids, kind="stable")
                for low in range(0, len(queries), BLOCK):
                    high = low + BLOCK
                    found = _nearest_of(numbers[low:high], queries[low:high], ids[order], points[order], k)
                    row, near, far = (np.concatenate(x) for x in zip((row, near, far), (found[0] + low, found[1], found[3]), strict=True))
                    at = np.concatenate([at, points[order][found[2]]])
                keep = _first(row, near, far, k)
                row, near, far, at = row[keep], near[keep], far[keep], at[keep]
        if not len(row):
            return
        to_lists = np.sqrt(_distances(queries, graph.value.centroids))
        rank = to_lists.argsort(1, kind="stable").argsort(1, kind="stable")
        unit = np.sort(to_lists, axis=1)[:, min(BASE, to_lists.shape[1]) - 1][:, None]
        ratio = to_lists / np.maximum(unit, 1e-6)
        of, used = graph.value.lists(at, COPIES, BOUNDARY)
        ranks = np.where(used, rank[row[:, None], of], len(graph.value.centroids)).min(1)
        ratios = np.where(used, ratio[row[:, None], of], np.inf).min(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (numbers[row], near, far, ranks.astype(np.int32), ratios.astype(float))],
            names=["query_id", "vec_id", "far", "rank", "ratio"],
        )

    found = vectors.mapInArrow(run, "query_id long, vec_id long, far double, rank int, ratio double")
    found = found.groupBy("query_id", "vec_id").agg(F.min(F.struct("far", "rank", "ratio")).alias("m")).select("query_id", "vec_id", "m.*")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("far", "vec_id"))
    found = found.withColumn("place", place).filter(F.col("place") <= k).select("rank", "ratio").toArrow()
    if not found.num_rows:
        return 1, 1.0
    ranks, ratios = (c.to_numpy() for c in found.columns)
    reached = 1 - (1 - recall) * BY_NUMBER
    probes = int(np.quantile(ranks, reached, method="higher")) + 1
    return probes, float(np.quantile(ratios[ranks < probes], recall / reached, method="higher")) * 1.0001


def _routed(rows: DataFrame, graph, most: int, ratio: float, base: int = 1) -> DataFrame:
    """Each row (a number and a vector) with its lists."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), *rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                numbers, use = graph.value.lists(_matrix(part.column(1)), most, ratio, base)
                row, column = np.nonzero(use)
                for begin in range(0, len(row), LIST_ROWS):
                    end = begin + LIST_ROWS
                    where = pa.array(row[begin:end])
                    number = pa.array(numbers[row[begin:end], column[begin:end]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([number, *(c.take(where) for c in part.columns)], names=schema.names)

    return rows.mapInArrow(run, schema)


def search(
    table: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    lists: int | None = None,
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest of each query row among all other rows: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id.
    Lists that hold more than ``LIST_ROWS`` vectors, as when one vector has many copies, are cut in parts by a
    hash of the row, each scanned apart; a part passes on at most ``k`` different ids for each query. ``lists`` is
    the number of lists, if not one for every ``LIST_SIZE`` vectors; ``recall`` is what the lists looked at are fitted for.

    Vectors that are null or zero, or hold null or non-finite components, rows without id, and vectors of another
    length than most (of two lengths equally often, the smaller) take no part. Rows that repeat a query's id are no
    candidates of it; repeated candidates count once, with their smallest distance. With fewer than ``k`` candidates
    in the lists looked at, all lists are scanned for that query.
    """
    values = table[f"`{vector}`"]
    if table.select(values.alias("v")).schema["v"].dataType != T.ArrayType(T.FloatType()):
        values = values.cast("array<double>")
    rows = table.select(table[f"`{vec_id}`"].cast("long").alias("vec_id"), values.alias("vector"), queries.alias("query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    spark = table.sparkSession
    length = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == length["length"])
    vectors = rows.select("vec_id", "vector")
    asked = rows.filter("query").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    shared = spark.sparkContext.broadcast(fit_centroids(vectors, length["n"], lists))
    probes, ratio = fit_probes(vectors, asked, shared, k, recall)
    postings = stored(_routed(vectors.distinct(), shared, COPIES, BOUNDARY), "postings")
    best = stored(_best(_scan(postings, _routed(asked, shared, probes, ratio, BASE), k), k), "nearest")
    enough = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    few = asked.join(enough, "query_id", "left_anti")
    if few.isEmpty():
        return best
    every = _routed(few, shared, len(shared.value.centroids), float("inf"))
    return _best(best.select("query_id", "vec_id", "score").union(_scan(postings, every, k)), k)


def _scan(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` of each query in each part of a list: ``query_id``, ``vec_id``, ``score``.

    A task holds the vectors of one part; the queries stream past them.
    """
    sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))
    # There are at most MOST_LISTS sizes.
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int")
    left = postings.join(F.broadcast(sizes), "list").select("list", part.alias("part"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "vector")
    sizes = sizes.select(F.col("list").alias("size_of"), F.col("parts").alias("cut_in"))
    each = F.explode(F.sequence(F.lit(0), F.col("cut_in") - 1))
    right = probes.join(F.broadcast(sizes), F.col("list") == F.col("size_of")).select("list", each.alias("part"), F.lit(1).alias("asks"), "query_id", "vector")
    ordered = left.union(right).repartition("list", "part").sortWithinPartitions("list", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, points = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, asks = np.stack([batch.column(i).to_numpy() for i in range(3)], 1), batch.column(2).to_numpy()
            numbers, vectors = batch.column(3).to_numpy(), _matrix(batch.column(4), np.float64)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            out = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if tuple(place[low, :2]) != key:
                    key, held, points = tuple(place[low, :2]), [], None
                if not asks[low]:
                    held.append((numbers[low:high], vectors[low:high]))
                    continue
                if points is None and held:
                    ids, points = (np.concatenate(x) for x in zip(*held, strict=True))
                    by = np.argsort(ids, kind="stable")
                    ids, points = ids[by], points[by]
                if points is None:
                    continue
                for at in range(low, high, BLOCK):
                    asking = numbers[at : min(high, at + BLOCK)]
                    row, near, _, far = _nearest_of(asking, vectors[at : min(high, at + BLOCK)], ids, points, k)
                    out.append((asking[row], near, far))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return ordered.mapInArrow(run, "query_id long, vec_id long, score double")


def _nearest_of(
    numbers: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest ids of each query among points in order of their ids: row of the query, id, row of the point, distance.

    Products of matrices choose the candidates, with room for rounding; differences give their distances.
    """
    starts = np.unique(ids, return_index=True)[1]
    scale = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :]
    rough = scale - 2 * (queries @ points.T)
    rough[numbers[:, None] == ids[None, :]] = np.inf
    by_id = np.minimum.reduceat(rough, starts, axis=1)
    limit = np.partition(by_id, k - 1, axis=1)[:, k - 1 : k] if k < by_id.shape[1] else np.full((len(queries), 1), np.inf)
    room = 16 * np.finfo(rough.dtype).eps * scale.max()
    row, column = np.nonzero(np.isfinite(rough) & (rough <= limit + room))
    far = np.sqrt(((points[column] - queries[row]) ** 2).sum(1)).astype(float)
    keep = _first(row, ids[column], far, k)
    return row[keep], ids[column[keep]], column[keep], far[keep]


def _first(row: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest different ids of each row, in order."""
    order = np.lexsort((far, ids, row))
    again = np.zeros(len(order), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[~again]
    order = order[np.lexsort((ids[order], far[order], row[order]))]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[rank < k]


def _best(found: DataFrame, k: int) -> DataFrame:
    """Nearest first, each candidate once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
