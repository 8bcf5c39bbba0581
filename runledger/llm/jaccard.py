"""Near duplicates: n-gram Jaccard join with Bayesian pruning of candidates.

Documents with the same set of word shingles form one class member list and are joined as one *set*. Sets that
share a band of MinHash values are candidates. For each candidate pair the MinHash values are compared step by
step; once the posterior probability that the similarity reaches the threshold is below the tolerance, the pair
is dropped. The rest is verified exactly on the shingles of the whole texts.

Small buckets give their pairs as rows. The sets of a large bucket are dealt in blocks; each pair of blocks is
compared within one task, which gives a row per set instead of a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from runledger.llm.common import PART_BYTES, add_columns, as_bytes, mixed, slices, stored, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 24  # a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^24 < 3.2e-6
TOLERANCE = 1e-6
STEP = 16
# Buckets of up to so many sets give rows of pairs; larger ones are compared in blocks.
PAIRED = 16
# Bytes of a block of a large bucket, at about ``SET_BYTES`` a set and ``SHINGLE_BYTES`` a shingle.
BLOCK_BYTES, SET_BYTES, SHINGLE_BYTES = 4 << 20, 512, 16
# Sets and shingles of a tile: the part of a block that is compared at once.
TILE_SETS, TILE_SHINGLES = 128, 1 << 15

_DRAW = np.random.default_rng(77)
_FACTOR = _DRAW.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_WEIGHT = _DRAW.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their number.

    A text of fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    code = np.zeros(n, np.uint64)
    for at, weight in enumerate(_WEIGHT):
        code[: max(0, n - at)] += hashes[at:] * weight
    left = np.repeat(begin + counts, counts) - np.arange(n)  # words from here to the end of the text
    valid = left >= SHINGLE
    for at in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        own = hashes[begin[at] : begin[at] + counts[at]]
        with np.errstate(over="ignore"):
            code[begin[at]] = (own * _WEIGHT[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        valid[begin[at]] = True
    code, owner = mixed(code[valid]), owner[valid]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    if len(code):
        first = np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))
        code, owner = code[first], owner[first]
    return code, np.bincount(owner, minlength=len(texts))


def sliced_shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """What ``shingles`` gives, of a slice of the texts at a time: hashing takes some fifty times their bytes."""
    parts = [shingles(texts[begin:end]) for begin, end in slices(texts, PART_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else shingles(texts)


def _sketch(texts: list[bytes | None], full: bool) -> dict[str, list]:
    code, counts = shingles(texts)
    begin = np.cumsum(counts) - counts
    some = counts > 0
    sums = np.zeros((len(texts), 2), np.uint64)
    if some.any():
        for i, salt in enumerate((0x51, 0xA7)):
            sums[some, i] = np.add.reduceat(mixed(code ^ np.uint64(salt * 0x0101010101010101)), begin[some])
    names = [row.tobytes() if ok else None for row, ok in zip(sums, some, strict=True)]
    out: dict[str, list] = {"gid": names, "n": counts.tolist()}
    if full:
        values = np.zeros((ROWS * BANDS, len(texts)), np.uint32)
        if some.any():
            for k in range(ROWS * BANDS):
                values[k, some] = np.minimum.reduceat((code * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), begin[some])
        out["signature"] = [row.tobytes() if ok else None for row, ok in zip(values.T.copy(), some, strict=True)]
    return out


def fewest_matches(threshold: float, tolerance: float, values: int = ROWS * BANDS, step: int = STEP) -> list[tuple[int, int]]:
    """For each number of compared values the fewest matches with which a pair is kept.

    With a uniform prior the posterior after ``m`` matches of ``n`` is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, values + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


_FIELDS = [
    T.StructField("gid", T.BinaryType()),
    T.StructField("n", T.LongType()),
    T.StructField("signature", T.BinaryType()),
]


def _band_rows(sets: DataFrame) -> DataFrame:
    """A row for each set and band: ``key`` of the values of the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
            keys = np.zeros((len(signature), BANDS), np.uint64)
            for band in range(BANDS):
                for value in range(band * ROWS, (band + 1) * ROWS):
                    keys[:, band] = mixed(keys[:, band] + signature[:, value] + np.uint64((band << 40) + 1))
            own = [np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1)]
            bands = np.tile(np.arange(BANDS, dtype=np.int32), len(signature))
            columns = [pa.array(x) for x in (*own, bands, keys.reshape(-1).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["set_no", "n", "band", "key"])

    return sets.select("set_no", "n", "signature").mapInArrow(run, "set_no long, n long, band int, key long")


def _members(rows: DataFrame) -> DataFrame:
    """Buckets of several sets, with these sets, their number and the number of blocks they fill.

    Counting combines before the shuffle; a hot bucket meets its many rows in a join that Spark may split.
    """
    filled = F.sum(F.col("n") * SHINGLE_BYTES + SET_BYTES) / BLOCK_BYTES
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.ceil(filled).cast("int").alias("blocks"))
    return rows.drop("n").join(sizes.filter("size > 1"), ["band", "key"])


def _paired(members: DataFrame) -> DataFrame:
    """All pairs ``a`` < ``b`` within small buckets: at most ``PAIRED`` sets are gathered in one row."""
    lists = members.filter(F.col("size") <= PAIRED).groupBy("band", "key").agg(F.array_sort(F.collect_set("set_no")).alias("all"))
    one = lists.select(F.posexplode("all").alias("at", "a"), "all")
    return one.select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b")).distinct()


def _possible(left: np.ndarray, right: np.ndarray, need: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the rows whose similarity may still reach the threshold; MinHash values are compared in steps."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in need:
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= least], n
    return alive


def _prune(pairs: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """Pairs of small buckets that stay possible. Those that share a large bucket too are found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, ROWS * BANDS) for i in (2, 3))
            shared = (left == right).reshape(-1, BANDS, ROWS).all(axis=2)
            crowded = (batch.column(4).to_numpy()[:, None] >> np.arange(BANDS)) & 1 > 0
            alive = np.flatnonzero(~(shared & crowded).any(axis=1))
            alive = pa.array(alive[_possible(left[alive], right[alive], need)])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(alive) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb", "crowded").mapInArrow(run, "a binary, b binary")


def _tiles(members: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Members in runs of at most ``TILE_SETS`` sets and about ``TILE_SHINGLES`` shingles."""
    out, begin, size = [], 0, 0
    for at, n in enumerate(counts[members].tolist()):
        if at > begin and (at - begin == TILE_SETS or size + n > TILE_SHINGLES):
            out.append(members[begin:at])
            begin, size = at, 0
        size += n
    return [*out, members[begin:]] if len(members) else out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each of some sets shares with each of others, as a product of 0-1 matrices."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(both)), np.float32 if len(both) < 1 << 24 else np.float64)
        for at, own in enumerate(sets):
            out[at, np.searchsorted(both, np.intersect1d(own, both, assume_unique=True))] = 1
        return out

    return np.rint(matrix(a) @ matrix(b).T).astype(np.int64) if len(both) else np.zeros((len(a), len(b)), np.int64)


def _spread_labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the first row of their connected group (rows without links: themselves)."""
    n = len(linked)
    rows, columns = np.arange(n), np.full(linked.shape[1], n)
    while True:
        columns = np.minimum(columns, np.where(linked, rows[:, None], n).min(axis=0))
        after = np.minimum(rows, np.where(linked, columns[None, :], n).min(axis=1))
        if (after == rows).all():
            return rows, columns
        rows = after


def _block_links(threshold: float, need: list[tuple[int, int]]):
    """Function over one pair of blocks of a large bucket: a row for each set with links in it.

    A pair is looked at in the first large bucket that it shares, so it counts once. Tiles of both blocks are
    compared: MinHash values in steps, then all shingles of the texts. ``root`` is a set of the same linked group.
    """

    def run(rows: pa.Table) -> pa.Table:
        band, left, right = (rows.column(c)[0].as_py() for c in ("band", "left", "right"))
        names = rows.column("gid").to_pylist()
        _, first = np.unique(np.array([n.hex() for n in names]), return_index=True)
        rows, names = rows.take(pa.array(first)), [names[i] for i in first.tolist()]
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
        block, crowded = rows.column("block").to_numpy(), rows.column("crowded").to_numpy()
        code, counts = sliced_shingles(as_bytes(rows.column("content").combine_chunks()))
        ends = np.cumsum(counts)
        # Number of the earlier large bucket of each set, or one of its own.
        buckets = np.empty((len(names), band), np.int64)
        for at in range(band):
            values = np.ascontiguousarray(signature[:, at * ROWS : (at + 1) * ROWS]).view(f"V{4 * ROWS}").reshape(-1)
            buckets[:, at] = np.where((crowded >> at) & 1 > 0, np.unique(values, return_inverse=True)[1], -1 - np.arange(len(names)))
        degree, parent = np.zeros(len(names), np.int64), list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        lefts = _tiles(np.flatnonzero(block == left), counts)
        rights = lefts if left == right else _tiles(np.flatnonzero(block == right), counts)
        for number, a in enumerate(lefts):
            for b in rights[number:] if left == right else rights:
                fits = np.minimum(counts[a][:, None], counts[b]) >= threshold * np.maximum(counts[a][:, None], counts[b])
                if a is b:
                    fits = np.triu(fits, 1)
                for at in range(band):
                    fits &= buckets[a, at][:, None] != buckets[b, at]
                i, j = np.nonzero(fits)
                alive = _possible(signature[a[i]], signature[b[j]], need)
                if not len(alive):
                    continue
                i, j = i[alive], j[alive]
                used, others = np.unique(i), np.unique(j)
                both = _common(*([code[ends[x] - counts[x] : ends[x]] for x in part.tolist()] for part in (a[used], b[others])))
                both = both[np.searchsorted(used, i), np.searchsorted(others, j)]
                near = both / (counts[a[i]] + counts[b[j]] - both) >= threshold
                linked = np.zeros(fits.shape, bool)
                linked[i[near], j[near]] = True
                # In a tile with itself a set is a row and a column.
                degree[a] += linked.sum(axis=1)
                degree[b] += linked.sum(axis=0)
                for members, labels in zip((a, b), _spread_labels(linked | linked.T if a is b else linked), strict=True):
                    for x, label in zip(members.tolist(), labels.tolist(), strict=True):
                        if label < len(a):
                            parent[root(x)] = root(int(a[label]))
        some = np.flatnonzero(degree).tolist()
        return pa.table(
            {
                "gid": pa.array([names[x] for x in some], pa.binary()),
                "root": pa.array([names[root(x)] for x in some], pa.binary()),
                "n_links": pa.array(degree[some], pa.int64()),
            }
        )

    return run


def _crowds(large: DataFrame, texts: DataFrame, threshold: float, need: list[tuple[int, int]]) -> DataFrame:
    """Links within large buckets: ``gid``, ``root``, ``n_links`` for the sets of each pair of blocks.

    A set is in one block of a bucket, by its number, and meets each block of the bucket in a task of its own.
    """
    block = F.pmod(F.xxhash64("set_no", "key"), F.col("blocks")).cast("int")
    dealt = large.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("set_no", "band", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    rows = dealt.join(texts, "set_no").select("band", "key", "left", "right", "block", "gid", "signature", "crowded", "content")
    return rows.groupBy("band", "key", "left", "right").applyInArrow(_block_links(threshold, need), "gid binary, root binary, n_links long")


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity of the shingle sets of two texts; rows with one left text come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            names, texts, others = batch.column(0).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))
            keep, found = [], []
            for at, (name, text, other) in enumerate(zip(names, texts, others, strict=True)):
                if name != last:
                    last, left = name, shingles([text])[0]
                right = shingles([other])[0]
                both = len(np.intersect1d(left, right, assume_unique=True))
                similarity = both / (len(left) + len(right) - both)
                if similarity >= threshold:
                    keep.append(at)
                    found.append(similarity)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.float64())], names=["a", "b", "jaccard"]
            )

    return rows.mapInArrow(run, "a binary, b binary, jaccard double")


def links(
    docs: DataFrame, sketches: DataFrame, text: str, doc_id: str, threshold: float, tolerance: float
) -> tuple[DataFrame, DataFrame]:
    """Links between different shingle sets with similarity from ``threshold`` on.

    First those of small buckets as pairs ``a``, ``b``, ``jaccard``; then those of large ones, a row for each
    set, task and bucket: ``gid``, ``root`` (a set of the same linked group), ``n_links``. No link is in both.
    """
    sets = sketches.filter(F.col("gid").isNotNull()).groupBy("gid").agg(
        F.min("doc_no").alias("doc_no"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    # Half of the digest serves as number where rows are many; should two sets share one, both are compared.
    number = F.conv(F.substring(F.hex("gid"), 1, 15), 16, 10).cast("long")
    sets = stored(sets.withColumn("set_no", number), "sets")
    members = stored(_members(_band_rows(sets)), "members")
    large, need = members.filter(F.col("size") > PAIRED), fewest_matches(threshold, tolerance)
    crowded = large.groupBy("set_no").agg(F.expr("bit_or(shiftleft(1L, band))").alias("crowded"))
    pairs = _paired(members)
    for name in ("a", "b"):
        own = sets.select(F.col("set_no").alias(name), F.col("n").alias(f"n{name}"))
        pairs = pairs.join(own.distinct(), name)
    pairs = pairs.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")).select("a", "b").distinct()
    pairs = pairs.join(crowded.withColumnRenamed("set_no", "a"), "a", "left").fillna(0, ["crowded"])
    for name in ("a", "b"):
        own = sets.select(F.col("set_no").alias(name), F.col("gid").alias(f"g{name}"), F.col("signature").alias(f"s{name}"))
        pairs = pairs.join(own, name)
    pairs = pairs.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "sa", "sb", "crowded")
    pairs = stored(_prune(pairs, need), "pairs")
    meeting = sets.join(crowded, "set_no").select("gid", "set_no", "signature", "crowded")
    wanted = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).union(meeting.select("gid")).distinct()
    wanted = wanted.join(sets.select("gid", "doc_no"), "gid").select(F.col("gid").alias("want"), "doc_no")
    source = docs.select(docs[f"`{doc_id}`"].alias("doc_no"), docs[f"`{text}`"].cast("string").alias("content"))
    found = add_columns(source.join(wanted, "doc_no"), "content", _FIELDS[:1], lambda t: {"gid": _sketch(t, False)["gid"]}, ["want", "content"])
    # A repeated id may bring texts of another set along, and a repeated row the same text twice.
    texts = stored(found.filter("gid = want").select("gid", "content").dropDuplicates(["gid"]), "texts")
    right = pairs.join(texts.select(F.col("gid").alias("b"), F.col("content").alias("other")), "b")
    both = right.join(texts.select(F.col("gid").alias("a"), "content"), "a")
    return (
        stored(_verify(both.select("a", "b", "content", "other"), threshold), "links"),
        stored(_crowds(large, meeting.join(texts, "gid"), threshold, need), "crowds"),
    )


def components(pairs: DataFrame) -> DataFrame:
    """Smallest member of each connected group: ``gid``, ``root``; only nodes with a pair appear.

    Every round gives each node the smallest label around it and then follows labels of labels; labels are cut
    from their lineage in the shared folder. Rounds are about the logarithm of the longest chain.
    """
    both = stored(pairs.select("a", "b").union(pairs.select("b", "a")), "edges")
    labels = stored(both.groupBy(F.col("a").alias("gid")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("gid").alias("b"), "root"), "b").groupBy(F.col("a").alias("gid")).agg(F.min("root").alias("near"))
        nearer = labels.join(near, "gid").select("gid", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("gid").alias("next"), F.col("root").alias("far"))
        after = nearer.join(jump, "next", "left").select(
            "gid", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) < F.col("root")).alias("moved")
        )
        after = stored(after, "labels")
        moved = after.filter("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            return labels


def jaccard_join(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its class), ``n_links`` (sets its own set is
    linked with) and ``n_copies`` (documents with its own set).

    Shingles are five words of whole texts. Documents whose sets are equal or linked, directly or over others,
    are one class. Copies are never paired. Every link counts, also in large groups of different near copies:
    their pairs are compared in blocks, without a row for each.

    A text that is null or has no words is a class of its own, as is a document whose id is null (its ``class_id``
    is null); repeated rows share their class; other columns play no part.
    """
    source = docs.select(docs[f"`{doc_id}`"].alias("doc_no"), docs[f"`{text}`"].cast("string").alias("content"))
    sketches = stored(add_columns(source, "content", _FIELDS, lambda t: _sketch(t, True), ["doc_no"]), "sketches")
    found, crowds = links(docs, sketches, text, doc_id, threshold, tolerance)
    degree = found.select(F.col("a").alias("gid")).union(found.select("b")).withColumn("n_links", F.lit(1)).union(crowds.select("gid", "n_links"))
    degree = degree.groupBy("gid").agg(F.sum("n_links").alias("n_links"))
    grouped = crowds.filter("gid <> root").select(F.col("gid").alias("a"), F.col("root").alias("b")).distinct()
    labels = components(found.select("a", "b").union(grouped)).join(degree, "gid", "left")
    counted = sketches.filter(F.col("gid").isNotNull()).groupBy("gid").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_no").alias("first"))
    classes = counted.join(labels, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    firsts = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = classes.join(firsts, "root").select("gid", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    several = classes.filter("n_copies > 1 or n_links > 0")
    rows = sketches.select("doc_no", "gid").join(several, "gid", "left")
    return rows.select(
        F.col("doc_no").alias("doc_id"),
        F.when(F.col("doc_no").isNotNull(), F.coalesce("class_id", "doc_no")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_first(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which each class keeps one: that with the smallest id; of rows with the same id the one
    with the smallest text. Rows with a null id stay."""
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    one = W.partitionBy(doc_id).orderBy(F.col(text))
    with_id = docs.join(kept, docs[f"`{doc_id}`"] == F.col("__kept"), "left_semi")
    with_id = with_id.withColumn("__no", F.row_number().over(one)).filter("__no = 1").drop("__no")
    return with_id.union(docs.filter(docs[f"`{doc_id}`"].isNull()))
