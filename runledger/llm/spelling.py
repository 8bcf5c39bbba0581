"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced code point changes the squared distance of two words' letter counts to at most
two, and their lengths by at most one. Words are dealt in blocks of one length and the next; within a block a NumPy
product of the letter counts gives all squared distances, pairs of at most two stay, and their edits are verified.

So that a block need not hold all words of a length: an edit of a word of length M leaves its first M // 2 or its
last M - M // 2 code points whole. Blocks are therefore keyed by such a half, and each pair meets in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import stored

LETTERS = "a-zA-ZÀ-ÿ"
SHORTEST, LEAST_COUNT, FACTOR = 7, 2, 10
DIMENSIONS = 32  # 26 for a-z, the others for the rest; sharing one only lets more pairs through
TILE = 256  # words whose counts are multiplied at once
TILE_CHARS = 1 << 18  # code points of such words
PART = 4_096  # words of a block that one task compares with as many others

_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (DIMENSIONS - 26) for c in range(1 << 8)])


def word_counts(
    docs: DataFrame, alter: Column | None = None, text: str = "text", shortest: int = SHORTEST, least: int = LEAST_COUNT
) -> DataFrame:
    """Words of whole texts and how often they occur: ``word``, ``n``.

    A word is a maximal run of letters, of which only A-Z are lower-cased; ``alter`` may change it, as an expression
    over ``run`` and the other columns of ``docs``. Words of fewer than ``shortest`` code points do not count. Null
    texts have no words; repeated rows count again.
    """
    lower = F.translate(docs[f"`{text}`"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Leftmost matches of that many letters begin where a run begins.
    others = [docs[f"`{c}`"] for c in docs.columns if c.lower() != "run"]
    runs = docs.select(*others, F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{shortest},}})"))).alias("run"))
    words = runs.select((F.col("run") if alter is None else alter).alias("word"))
    counted = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least)


def _blocks(words: DataFrame, shortest: int) -> DataFrame:
    """Each word under its halves: as one of length M, and, if longer than the shortest, as one a code point longer
    than M. ``base`` is M; ``longer`` tells which it is; ``block`` names the half."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {shortest})")).alias("base"))
    half = F.floor(F.col("base") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("last"), F.xxhash64(F.lit(0), F.col("word").substr(F.lit(1), half)).alias("block")),
        F.struct(F.lit(1).alias("last"), F.xxhash64(F.lit(1), F.expr("right(word, base - cast(floor(base / 2) as int))")).alias("block")),
    )
    rows = rows.select("word", "n", "base", (length > F.col("base")).cast("int").alias("longer"), F.explode(halves).alias("h"))
    return rows.select("base", "h.last", "h.block", "longer", "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    cell = owner * DIMENSIONS + _CLASS[points & 255]
    counts = np.bincount(cell, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)
    # Sums of squares stay exact: below 2^24 in single precision, below 2^53 in double.
    return counts.astype(np.float32 if lengths.max(initial=0) < 1 << 11 else np.float64)


def close_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letter counts are at a squared distance of at most two."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) <= 2


def one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Whether pairs of words, the second as long as the first or a code point longer, are exactly one edit apart."""
    out = np.zeros(len(short), bool)
    for at, (a, b) in enumerate(zip(short, long, strict=True)):
        low, high = 0, len(a)
        while low < high:  # the length of the common prefix
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
        out[at] = a != b and (a[low:] == b[low + 1 :] if len(a) < len(b) else a[low + 1 :] == b[low + 1 :])
    return out


class _Group:
    """Words of some blocks of one length: those of this length, then those a code point longer."""

    def __init__(self, base: int, rows: list[tuple]):
        self.base = base
        self.last = [r[0] > 0 for r in rows]
        self.block = np.array([r[1] for r in rows])
        self.side = np.array([r[2] for r in rows])
        self.longer = np.array([r[3] for r in rows]) > 0
        self.words = [r[4] for r in rows]
        self.n = np.array([r[5] for r in rows])
        self.counts = letter_counts(self.words)

    def pairs(self, cut: bool) -> Iterator[tuple[int, int]]:
        """Near words, the shorter first. ``cut``: only words of the two sides of a block that is cut in parts."""
        step = max(1, min(TILE, TILE_CHARS // (self.base + 1)))
        half = self.base // 2
        starts, order = range(0, len(self.words), step), np.arange(len(self.words))
        for x in starts:
            for y in starts:
                a, b = slice(x, x + step), slice(y, y + step)
                wanted = (self.block[a][:, None] == self.block[b]) & ~self.longer[a][:, None]
                # Two words of one length are looked at once.
                wanted &= self.longer[b][None, :] | (order[a][:, None] < order[b])
                if cut:
                    wanted &= self.side[a][:, None] != self.side[b]
                if not wanted.any():
                    continue
                i, j = np.nonzero(wanted & close_counts(self.counts[a], self.counts[b]))
                i, j = i + x, j + y
                near = one_edit([self.words[p] for p in i.tolist()], [self.words[q] for q in j.tolist()])
                for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    # A pair with both halves in common counts with the first.
                    if (self.words[p][:half] == self.words[q][:half]) != self.last[p]:
                        yield p, q


def near_words(words: DataFrame, shortest: int = SHORTEST, part: int = PART) -> DataFrame:
    """Each word (``word``, ``n``) with each word one edit away: ``word``, ``near``, ``near_n``; both directions.

    A block of more than ``part`` words is cut in parts, and each two parts meet in a task of their own.
    """
    rows = _blocks(words, shortest)
    key = ["base", "last", "block"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select(
        *key, F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") <= F.col("other")).cast("int").alias("side"), "longer", "word", "n"
    )
    place = [*key, "left", "right"]
    # Blocks of one length lie together, so that many small ones share a product.
    ordered = rows.repartition(*place).sortWithinPartitions(*place, "longer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(kind: tuple | None, group: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not group:
                return
            own = _Group(kind[0], group)
            found = list(own.pairs(cut=kind[1] != kind[2]))
            for begin in range(0, len(found), 1 << 14):
                i, j = (np.array(x) for x in zip(*found[begin : begin + (1 << 14)], strict=True))
                left, right = np.concatenate([i, j]).tolist(), np.concatenate([j, i]).tolist()
                columns = [pa.array([own.words[p] for p in left]), pa.array([own.words[q] for q in right]), pa.array(own.n[right])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

        # A group takes whole blocks of one length up to a tile; of a cut block, two parts stand alone.
        group, kind, block, at = [], None, [], None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal group, kind, block
            if len(block) > 1:
                base, _, name, left, right = at
                own = (base, left, right, name if left != right else None)
                if own != kind or len(group) + len(block) > min(TILE, TILE_CHARS // base):
                    yield from results(kind, group)
                    group, kind = [], own
                group += block
            block = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != at:
                    yield from closed()
                    at = row[:5]
                block.append((row[1], row[2], *row[5:]))
        yield from closed()
        yield from results(kind, group)

    return ordered.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word``, ``root`` at the end of its chain of forms; each round follows chains twice as far."""
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = stored(known.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known


def variants(words: DataFrame, factor: int = FACTOR, shortest: int = SHORTEST, part: int = PART) -> DataFrame:
    """Each word (``word``, ``n``) with its ``form``, ``root``, ``n_near`` and ``form_n``.

    ``form`` is the most frequent word one edit away (ties: the smallest in code-point order), if it occurs at least
    ``factor`` times as often; ``form_n`` says how often. ``root`` is the end of the chain of forms, or the word.
    Words without near words have ``n_near`` 0; an empty table gives none.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, shortest, part).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= F.col("n") * factor
    joined = words.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    joined = stored(joined, "forms")
    # Along a chain counts grow by the factor each time, which bounds its length.
    most, length = joined.agg(F.max("n")).first()[0] or 1, 1
    while most >= factor > 1:
        most, length = most // factor, length + 1
    ends = roots(joined.filter(F.col("form").isNotNull()), (length - 1).bit_length())
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
