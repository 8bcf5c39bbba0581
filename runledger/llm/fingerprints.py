"""Document fingerprints: MinHash signatures of word shingles, and likeness to edited texts and to the next document.

Each of the signature's values is the least of a universal hash of all shingles, one hash function a value, computed
over many texts at once in NumPy. The share of equal values estimates the Jaccard similarity of two texts. Values in
bands of four serve as keys: near duplicates meet in Spark joins on bands, and their similarity is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runledger.llm.common import as_bytes, free_name, slices, stored
from runledger.llm.jaccard import BANDS, ROWS, THRESHOLD, TOLERANCE, _sketch as set_names, components, links, shingles

VALUES = ROWS * BANDS
NOTHING = np.uint32(0xFFFFFFFF)  # all values of a text without words
SAMPLED = 100  # sampled rows for each part that texts are dealt to, as Spark takes for its own ranges
MOST_SAMPLED = 1_000_000

_RNG = np.random.default_rng(1109)
# x -> ((a x + b) mod 2^64) >> 32 with random a and b is a universal family over 32-bit keys.
_A = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64)
_B = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64)


def signatures(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signature of each text, one row each, from the shingles of all texts and their number in each."""
    out = np.full((VALUES, len(counts)), NOTHING, np.uint32)
    some = counts > 0
    if some.any():
        begin = (np.cumsum(counts) - counts)[some]
        keys = codes & np.uint64(0xFFFFFFFF)
        for at in range(VALUES):
            out[at, some] = np.minimum.reduceat((keys * _A[at] + _B[at]) >> np.uint64(32), begin)
    return np.ascontiguousarray(out.T)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of signatures, row by row."""
    return (a == b).mean(axis=1)


def share_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether signatures have a band in common, and so meet in a join on bands."""
    return (a == b).reshape(len(a), BANDS, ROWS).all(axis=2).any(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter, rounded down, replaced by as many code points of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _verified(left: list[np.ndarray], right: list[np.ndarray], meet: np.ndarray) -> list[float | None]:
    """Jaccard similarity of the shingles of pairs that share a band; None for the others."""
    out: list[float | None] = [None] * len(meet)
    for at in np.flatnonzero(meet).tolist():
        both = len(np.intersect1d(left[at], right[at], assume_unique=True))
        union = len(left[at]) + len(right[at]) - both
        out[at] = both / union if union else 1.0
    return out


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, jaccard_edited double, jaccard_next double"
)


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Result rows of consecutive documents; the last text is only the next one of the last row."""
    own, changed = texts[:-1], [edited(a, b) for a, b in zip(texts, texts[1:])]
    sets, prints = [], []
    for part in (texts, changed):
        codes, counts = shingles([t.encode("utf-8", "surrogatepass") for t in part])
        sets.append(np.split(codes, np.cumsum(counts)[:-1]))
        prints.append(signatures(codes, counts))
    at, after, new = prints[0][:-1], prints[0][1:], prints[1]
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        *(pa.array([row.astype(">u4").tobytes().hex() for row in x]) for x in (at, new)),
        *(pa.array(likeness(at, x)) for x in (new, after)),
        *(pa.array(_verified(sets[0], x, share_band(at, y)), pa.float64()) for x, y in ((sets[1], new), (sets[0][1:], after))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _RESULT.split(", ")])


def _below(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the number of the last bound that is not above it; both are rows of sort keys."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(bounds) - 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        other, above, same = bounds[middle], np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for key in range(rows.shape[1]):
            above |= same & (other[:, key] > rows[:, key])
            same &= other[:, key] == rows[:, key]
        low, high = np.where(above, low, middle), np.where(above, middle - 1, high)
    return low


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, its ``fingerprint``, and that of its edited text, whose last
    quarter is replaced by the beginning of the next document (``edited_fingerprint``, ``edited_sha256``).

    ``near_edited`` and ``near_next`` are the likeness of its fingerprint to those of the edited text and of the
    next document; ``jaccard_edited`` and ``jaccard_next`` the exact similarity of the shingles, where the
    fingerprints share a band, else null. Next is the next in ascending order of id (null ids first; rows of one id
    by a hash of the text), and after the last comes the first; a lone document follows itself.

    Texts are shuffled once, to ranges of that order, and a range's first document also to the range before. The
    bounds are rows of a sample of bounded size. Rows of one id, and equal rows, spread over ranges like others.

    A null text is taken for an empty one. A text without words has a fingerprint of its own kind: likeness 1 to
    others without words, else 0. Repeated rows are rows of their own. Other columns play no part.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), content.alias("content"))
    # Equal rows differ by their place in the input, which must be read in the same order again.
    rows = rows.select(
        "doc_id", "content", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k0"), F.xxhash64("content").alias("k1"), F.monotonically_increasing_id().alias("k2")
    )
    keys = ["k0", "k1", "k2"]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("first")).first()
    if not first["n"]:
        return spark.createDataFrame([], _RESULT)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_SAMPLED, SAMPLED * parts)
    chance = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(min(1 << 30, (wanted << 30) // first["n"] + 1))
    sample = rows.select(*keys).filter(chance).limit(2 * wanted).toArrow()
    drawn = np.stack([c.to_numpy() for c in sample.columns], axis=1) if sample.num_rows else np.zeros((0, 3), np.int64)
    drawn = drawn[np.lexsort(drawn.T[::-1])][:: max(1, -(-len(drawn) // parts))][1:]
    bounds = np.concatenate([np.array([list(first["first"])], np.int64), drawn])
    bounds = bounds[np.concatenate(([True], (bounds[1:] != bounds[:-1]).any(axis=1)))]
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value
        for batch in batches:
            own = np.stack([batch.column(i).to_numpy() for i in (2, 3, 4)], axis=1)
            part = _below(limits, own)
            opening = np.flatnonzero((limits[part] == own).all(axis=1))
            for numbers, at, ends in ((part, np.arange(len(part)), 0), ((part[opening] - 1) % len(limits), opening, 1)):
                if len(at):
                    head = [pa.array(numbers.astype(np.int32)), pa.array(np.full(len(at), ends, np.int32))]
                    yield pa.RecordBatch.from_arrays([*head, *batch.take(pa.array(at)).columns], names=["part", "ends", *batch.schema.names])

    dealt = rows.mapInArrow(deal, "part int, ends int, doc_id long, content string, k0 long, k1 long, k2 long")
    ordered = dealt.repartition(len(bounds), "part").sortWithinPartitions("part", "ends", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts = None, [], []
        for batch in batches:
            places, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, contents = numbers, as_bytes(batch.column(2))
            for begin, end in slices(contents):
                for at in range(begin, end):
                    if places[at] != part:
                        part, ids, texts = places[at], [], []  # what is left is the opening row of the part after
                    ids.append(names[at])
                    texts.append(contents[at].decode("utf-8", "surrogatepass"))
                    last = at + 1 == end or places[at + 1] != part
                    if last and len(texts) > 1:
                        yield _compared(ids[:-1], texts)
                        ids, texts = ids[-1:], texts[-1:]

    return ordered.select("part", "doc_id", "content").mapInArrow(run, _RESULT)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Each document with the smallest id of its class: ``doc_id``, ``class_id``, ``fingerprint``.

    Texts with equal shingles are one member. Members that share a band of their fingerprints meet, and are linked
    if the similarity of all their shingles reaches ``threshold``; linked members, directly or over others, are one
    class. A text without words, or a document without id, is a class of its own.
    """
    own, result = free_name("content", [doc_id]), "doc_no long, gid binary, n long, signature binary"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for begin, end in slices(texts):
                codes, counts = shingles(texts[begin:end])
                names = set_names(texts[begin:end], False)["gid"]
                prints = [row.tobytes() for row in signatures(codes, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(prints, pa.binary())],
                    names=["doc_no", "gid", "n", "signature"],
                )

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_no"), docs[f"`{text}`"].cast("string").alias(own))
    sketches = stored(rows.mapInArrow(sketch, result), "fingerprints")
    pairs, crowds = links(docs, sketches, text, doc_id, threshold, TOLERANCE)
    grouped = crowds.filter("gid <> root").select(F.col("gid").alias("a"), F.col("root").alias("b")).distinct()
    labels = components(pairs.select("a", "b").union(grouped))
    members = sketches.join(labels, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    firsts = members.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_no").alias("class_id"))
    return members.join(firsts, "root", "left").select(
        F.col("doc_no").alias("doc_id"),
        F.when(F.col("doc_no").isNotNull(), F.coalesce("class_id", "doc_no")).alias("class_id"),
        F.lower(F.hex("signature")).alias("fingerprint"),
    )
