"""Benchmark decontamination with a generalised suffix automaton over words.

The items' words become one automaton whose states stand for all word runs that occur in some item. A
document streams through it; after every word the automaton knows the longest run ending there that is
also in an item. A run of ``window`` words (or a whole item with fewer words) is an occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from runledger.llm.common import WORD_TABLE, add_columns, free_name, words

# Words of benchmark items that one automaton takes; with more, several automata run one after another.
AUTOMATON_WORDS = 2_000_000


class Automaton:
    """Generalised suffix automaton of word lists."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [
            (name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in run]) for name, run in items if run
        ]
        self.least = min((min(window, len(run)) for _, run in coded), default=0)
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, run in coded:
            last = 0
            for word in run:
                last = self._extend(last, word)
        self._name_items(coded)
        width = len(self.vocabulary)
        pairs = [a * width + b for _, run in coded for a, b in zip(run, run[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            return self._split(last, word)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            link[new] = self._split(at, word)
        return new

    def _split(self, at: int, word: int) -> int:
        """The state whose longest run is that of ``at`` and the word; made by a copy if need be."""
        step, link, length = self.step, self.link, self.length
        old = step[at][word]
        if length[old] == length[at] + 1:
            return old
        copy = len(step)
        step.append(dict(step[old]))
        link.append(link[old])
        length.append(length[at] + 1)
        link[old] = copy
        while at >= 0 and step[at].get(word) == old:
            step[at][word] = copy
            at = link[at]
        return copy

    def _name_items(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items hold the window of a state, and which short items end in it."""
        states = len(self.step)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        self.home = [0] * states  # where on the way to the root the run of window words lives
        for at in order:
            if self.length[at] >= self.window:
                up = self.link[at]
                self.home[at] = at if self.length[up] < self.window else self.home[up]
        self.holders: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, run in coded:
            at = 0
            for count, word in enumerate(run, 1):
                at = self.step[at][word]
                if count >= self.window:
                    self.holders.setdefault(self.home[at], set()).add(name)
            if len(run) < self.window:
                short.setdefault(at, []).append((len(run), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for at in order[1:]:
                chain = short.get(at, []) + self.short.get(self.link[at], [])
                if chain:
                    self.short[at] = chain

    def _runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches that may hold an occurrence: every word, and every pair of words, is in some item."""
        known = codes >= 0
        if self.least > 1:
            pair = known[1:] & known[:-1]
            at = np.flatnonzero(pair)
            if at.size:
                code = codes[at].astype(np.int64) * len(self.vocabulary) + codes[at + 1]
                place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                pair[at] = self.pairs[place] == code
            flags, need = pair, self.least - 1
        else:
            flags, need = known, 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= need:
                yield begin, end + (self.least > 1)

    def occurrences(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans of a document that are inside an occurrence, and the items concerned."""
        if not self.least or len(run) < self.least:
            return [], set()
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in run), np.int32, len(run))
        spans: list[tuple[int, int]] = []
        homes: set[int] = set()
        found: set[str] = set()
        step, link, length, window = self.step, self.link, self.length, self.window
        for begin, end in self._runs(codes):
            at = matched = 0
            for place, word in enumerate(codes[begin:end].tolist(), begin + 1):
                while at and word not in step[at]:
                    at = link[at]
                    matched = length[at]
                if word in step[at]:
                    at, matched = step[at][word], matched + 1
                longest = 0
                if matched >= window:
                    longest = window
                    homes.add(self.home[at])
                for size, name in self.short.get(at, ()):
                    if size <= matched:
                        longest = max(longest, size)
                        found.add(name)
                if longest:
                    if spans and spans[-1][1] >= place - longest:
                        low = place - longest
                        while spans and spans[-1][1] >= low:
                            low = min(low, spans.pop()[0])
                        spans.append((low, place))
                    else:
                        spans.append((place - longest, place))
        for home in homes:
            found |= self.holders[home]
        return spans, found


def _blocks(items: DataFrame, item_id: str, item_text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as word lists, so many at a time as one automaton takes; the driver holds one block."""
    rows = items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`").cast("string"))
    block, size = [], 0
    for name, text in rows.toLocalIterator():
        run = words((text or "").encode("utf-8", "replace"))
        if name is None or not run:
            continue
        if block and size + len(run) > most:
            yield block
            block, size = [], 0
        block.append((name, run))
        size += len(run)
    yield block


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    one_in: int = 20,
    keep: list[str] | None = None,
    cut: bool = False,
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Adds ``n_words``, ``n_hit`` (words inside an occurrence), ``hit_spans`` (word positions, end exclusive,
    merged), ``hit_items`` (ids as strings, sorted), ``contaminated`` (at least one word in ``one_in`` is hit)
    and, with ``cut``, ``kept_text``: the text without its hit spans.

    Documents are only mapped, never shuffled. Items are read in blocks of at most ``automaton_words`` words;
    each block's automaton, of bounded size, goes to the executors, and each further block is a further pass
    over the same rows. A null or empty text has no words and is not contaminated; items without id or words
    match nothing; repeated items and documents each count; new columns replace columns of the same name.
    """
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    hit = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    new = {"n_words", "n_hit", "hit_spans", "hit_items", "contaminated"} | ({"kept_text"} if cut else set())
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # A text that is carried along serves as it is; another one goes along until nothing needs it.
    extra = [] if text in carried else [free_name("__source", carried)]
    source = extra[0] if extra else text
    out = docs.select(*[docs[f"`{c}`"] for c in carried], *[docs[f"`{text}`"].alias(c) for c in extra])
    works = {}
    for block in _blocks(items, item_id, item_text, automaton_words):
        name = free_name(f"__pass{len(works)}", out.columns)
        works[name] = _pass(docs, block, window, name)
    passes = list(works)
    for name, work in works.items():
        spent = [] if cut or name != passes[-1] else extra
        out = add_columns(out, source, [T.StructField(name, hit)], work, [c for c in out.columns if c not in spent])
    first = F.col(passes[0])
    if len(passes) == 1:
        spans, found = first["spans"], first["items"]
    else:
        spans = _merged(F.flatten(F.array(*[F.col(p)["spans"] for p in passes])))
        found = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in passes]))))
    out = out.select(
        *[f"`{c}`" for c in out.columns if c not in passes],
        first["n_words"].alias("n_words"),
        spans.alias("hit_spans"),
        found.alias("hit_items"),
    )
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    out = out.withColumn("n_hit", hits).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    )
    if cut:
        out = out.withColumn("kept_text", F.pandas_udf(_cut, "string")(F.col(source), F.col("hit_spans")))
    return out.drop(*extra)


def _pass(docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int, name: str):
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))

    def work(texts: list) -> dict[str, list]:
        out = []
        for content in texts:
            run = words(content)
            spans, found = shared.value.occurrences(run)
            spans = [{"begin": b, "end": e} for b, e in spans]
            out.append({"n_words": len(run), "spans": spans, "items": sorted(found)})
        return {name: out}

    return work


def _merged(spans: Column) -> Column:
    """Spans in order, overlapping and touching ones joined."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) == 0) | (span["begin"] > last["end"]), F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<begin:int,end:int>>"), add)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts without the words of their spans and what stands between those."""
    out = []
    for text, cuts in zip(texts, spans, strict=True):
        if text is None or not len(cuts):
            out.append(text)
            continue
        content = text.encode("utf-8", "replace")
        places = [m.span() for m in re.finditer(rb"[^ ]+", content.translate(WORD_TABLE))]
        pieces, at = [], 0
        for cut in cuts:
            pieces.append(content[at : places[cut["begin"]][0]])
            at = places[cut["end"] - 1][1]
        out.append((b"".join(pieces) + content[at:]).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)
