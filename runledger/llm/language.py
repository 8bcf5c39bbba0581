"""Language identification with a bit-sliced Bloom filter over letter n-grams.

Every slot of the filter holds one bit per language, in as many words as the languages need; the bits that all slots of an n-gram share say which
languages contain it. The hits of a text are counted per language and corrected for false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from runledger.llm.common import add_columns, mixed, text_slices

ORDER = 4
HASHES = 3
WORD = 64  # languages that one word of a slot has bits for
UNKNOWN = "und"
FOREIGN = 0.1  # an n-gram this much rarer in a language than in another one comes from quoted text, not the language
# Lower-cases A-Z; every other ASCII character becomes a blank.
_TABLE = bytes(c if c > 127 or 97 <= c <= 122 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``ORDER`` bytes in the texts, and how many each text has.

    N-grams are taken inside words with one blank on either side; several blanks count as one.
    """
    joined = [b" " + b" ".join((t or b"").translate(_TABLE).split()) + b" " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
    data = np.frombuffer(b"".join(joined) + b" " * ORDER, np.uint8)
    n = int(ends[-1]) if len(ends) else 0
    code = np.zeros(n, np.uint32)
    for at in range(ORDER):
        code = (code << np.uint32(8)) | data[at : n + at]
    within = np.ones(n, bool)
    for at in range(1, ORDER - 1):
        within &= data[at : n + at] != 32
    where = np.flatnonzero(within)
    counts = np.diff(np.searchsorted(where, ends), prepend=0)
    return mixed(code[where].astype(np.uint64)), counts


def _runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of two arrays, in order, and how often each occurs."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[new], second[new], np.diff(np.flatnonzero(new), append=len(order))


@dataclass
class LanguageFilter:
    """Slots of language bits; ``false`` is the chance, by language, that an unknown n-gram seems known."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, languages: list[str], known: list[np.ndarray], bits_per_gram: int = 24) -> LanguageFilter:
        largest = max([len(k) for k in known], default=0)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, largest * bits_per_gram)))))
        slots = np.zeros((size, max(1, -(-len(languages) // WORD))), np.uint64)
        filled = []
        for number, hashes in enumerate(known):
            word, bit = number // WORD, np.uint64(number % WORD)
            for at in cls._places(hashes, size):
                slots[at, word] |= np.uint64(1) << bit
            filled.append(float(((slots[:, word] >> bit) & np.uint64(1)).mean()))
        return cls(languages, slots, np.array(filled) ** HASHES)

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        mask, step = np.uint64(size - 1), (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((hashes + step * np.uint64(k)) & mask).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For every n-gram the bits of all languages that contain it, a column for each ``WORD`` languages."""
        out = np.full((len(hashes), self.slots.shape[1]), ~np.uint64(0))
        for at in self._places(hashes, len(self.slots)):
            out &= self.slots[at]
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and share of known n-grams of each text.

        The score is the winner's share of the n-grams that at most half of the languages know (of all
        n-grams, if there are none); it is 0 where nothing is known.
        """
        hashes, counts = grams(texts)
        masks = self.masks(hashes)
        begin = np.cumsum(counts) - counts
        known = np.zeros((len(texts), len(self.languages)))
        full = counts > 0
        for number in range(len(self.languages)):
            hit = ((masks[:, number // WORD] >> np.uint64(number % WORD)) & np.uint64(1)).astype(np.int64)
            sums = np.add.reduceat(hit, begin[full]) if full.any() else np.zeros(0)
            known[full, number] = sums
        n = counts[:, None]
        known = np.clip((known - n * self.false) / (1 - self.false), 0, n)
        names, scores, shares = [], [], []
        for text, row, count in zip(texts, known, counts.tolist(), strict=True):
            if not self.languages or not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                names.append(UNKNOWN)
                scores.append(0.0)
                shares.append(0.0)
                continue
            best = int(row.argmax())
            rest = np.delete(row, best).max() if len(row) > 1 else 0.0
            names.append(self.languages[best])
            scores.append(float((row[best] - rest) / row[best]) if row[best] > 0 else 0.0)
            shares.append(float(row[best] / count) if count else 0.0)
        return names, scores, shares


def fit_filter(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    train: Column | None = None,
    per_language: int = 3_000,
    least: int = 3,
    foreign: float = FOREIGN,
) -> LanguageFilter:
    """Filter of the n-grams that each language uses, learned from labelled rows.

    About ``per_language`` different texts of a language are taken, by a hash of the text; however often a text is
    repeated, it counts once. The driver gets the n-grams of these texts alone. All of them go into the filter that
    stand in ``least`` texts (in fewer, where a language has fewer than ten times as many texts) and, as a share of the
    texts, at least ``foreign`` times as often as in any other language. Any number of languages will do; the filter grows with it. Rows with null text or label teach nothing; without any labelled row
    the filter knows no language.
    """
    rows = docs if train is None else docs.filter(train)
    rows = rows.select(F.col(f"`{label}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashes = rows.select("lang", F.xxhash64("text").alias("text")).distinct()
    sizes = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter.build([], [])
    plan = [
        (n, name, min(1.0, per_language / sizes[name]), min(least, max(1, sizes[name] // 10)), float(min(sizes[name], per_language)))
        for n, name in enumerate(languages)
    ]
    # An Arrow table becomes a local relation; a list of rows would go through Python workers of a kind of their own.
    names, kinds = ("number", "lang", "share", "least", "texts"), (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64())
    plan = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*plan, strict=True), kinds, strict=True)], names))
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    # One row a language.
    picked = rows.join(F.broadcast(plan), "lang").filter(unit < F.col("share")).select("number", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for begin, end, texts in text_slices(batch.column(1)):
                found, counts = grams(texts)
                of = np.repeat(np.arange(end - begin), counts)
                of, found, _ = _runs(of, found)
                language, gram, n = _runs(numbers[begin:end][of], found)
                arrays = [pa.array(language), pa.array(gram.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, names=["number", "gram", "n"])

    counted = picked.mapInArrow(count, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    kept = counted.join(F.broadcast(plan.select("number", "least", "texts")), "number").withColumn("rate", F.col("n") / F.col("texts"))
    # An n-gram has a row for each language, no more.
    kept = kept.withColumn("highest", F.max("rate").over(W.partitionBy("gram")))
    kept = kept.filter((F.col("n") >= F.col("least")) & (F.col("rate") >= F.col("highest") * foreign)).select("number", "gram").toArrow()
    numbers, gram = kept.column(0).to_numpy(), kept.column(1).to_numpy().view(np.uint64)
    order = np.argsort(numbers, kind="stable")
    return LanguageFilter.build(languages, np.split(gram[order], np.searchsorted(numbers[order], np.arange(1, len(languages)))))


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` (a learned language; ``und`` for a text that is null or has no letter, or where nothing
    was learned), ``lang_score`` (0 to 1: the winner's lead over the next language) and ``lang_share`` (0 to 1:
    the n-grams known to the winner).

    A map without a shuffle. Ties go to the language first by name; repeated
    rows get the same answer; new columns replace columns of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_share", T.DoubleType()),
    ]

    def work(texts: list) -> dict[str, list]:
        return dict(zip((f.name for f in fields), shared.value.predict(texts), strict=True))

    return add_columns(docs, text, fields, work, keep)
