"""Removal of repeated byte strings with suffix arrays built in two stages.

Every string of ``LENGTH`` bytes is owned by one *anchor*: of the shorter strings inside it, the first with the
smallest hash. Equal strings have equal anchors, so it is enough to compare strings under one anchor. Strings in a
row that an anchor owns form a *piece*. Equal pieces are merged by digest; where an anchor has different pieces,
their bytes meet in a task, and a suffix array with the common prefixes of neighbours finds the equal strings.

Two stages: suffixes smaller than their successors are sorted directly; all others are induced from them by one
scan over the buckets of first bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import as_bytes, mixed, prefix_hashes, slices, stored

LENGTH = 100
ANCHOR = 40
SPAN = LENGTH - ANCHOR + 1  # places in a string where its anchor may be
# Different pieces of one anchor that meet in one suffix array; anchors with more compare string by string.
TOGETHER = 1000
PART = 16
BLOCK = 1 << 19  # bytes of pieces in one suffix array
END = 0xFF  # a byte that UTF-8 does not have


def pieces(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Pieces of all texts: number of the text, anchor, digest (with the count in the low bits), first string,
    count of strings."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join([t or b"" for t in texts]), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums, back = prefix_hashes(data)
    n = len(data) - ANCHOR + 1
    values = mixed((sums[ANCHOR:] - sums[:n]) * back[:n])
    # Smallest of SPAN neighbours by doubling. The place in the low half makes the first of equal ones win.
    low, width = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64), 1
    while 2 * width <= SPAN:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    strings = len(data) - LENGTH + 1
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[:strings]
    inside = np.arange(strings) + LENGTH <= begin[text] + sizes[text]
    change = np.ones(strings, bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change & inside)
    if not len(first):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    valid = np.concatenate(([0], np.cumsum(inside)))
    edges = np.append(np.flatnonzero(change), strings)
    after = edges[np.searchsorted(edges, first, side="right")]
    count = valid[after] - valid[first]
    end = first + count + LENGTH - 1
    digest = mixed((sums[end] - sums[first]) * back[first] + (place[first] - first).astype(np.uint64))
    digest = (digest & ~np.uint64(127)) | count.astype(np.uint64)
    return text[first], values[place[first]], digest, first - begin[text[first]], count


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of a byte text, in the order of at least the first ``depth`` bytes.

    First stage: suffixes smaller than their successors are sorted by their bytes. Second stage: the buckets of
    first bytes are scanned in order, and each suffix found puts its predecessor, if that is larger than it, at the
    next free place of its bucket.
    """
    n = len(text)
    symbol = text.astype(np.int16)
    step = np.diff(symbol, append=-1)
    nonzero = np.where(step != 0, np.arange(n), n)
    upcoming = np.minimum.accumulate(nonzero[::-1])[::-1]
    small = step[np.minimum(upcoming, n - 1)] > 0
    chosen = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = [_words(padded, chosen + at) for at in range(0, depth, 8)]
    chosen = chosen[np.lexsort(words[::-1])]
    by_bucket = np.split(chosen, np.searchsorted(symbol[chosen], np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            target = symbol[before]
            order = np.argsort(target, kind="stable")
            before, target = before[order], target[order]
            edges = np.flatnonzero(np.diff(target)) + 1
            for part in np.split(before, edges):
                induced[symbol[part[0]]].append(part)

    if n and not small[n - 1]:
        induced[symbol[n - 1]].append(np.array([n - 1]))  # the empty suffix after the end comes first of all
    out = []
    for bucket in range(256):
        at = 0
        while at < len(induced[bucket]):
            found = induced[bucket][at]
            out.append(found)
            induce(found)
            at += 1
        if len(by_bucket[bucket]):
            out.append(by_bucket[bucket])
            induce(by_bucket[bucket])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _words(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view(">u8")[:, 0].astype(np.uint64)


def equal_runs(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix in order, the number of its class: neighbours with a common prefix of ``length`` bytes."""
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        word = _words(padded, order + at) if len(left) * 2 > len(same) else None
        if word is not None:
            same &= word[1:] == word[:-1]
        else:
            same[left] = _words(padded, order[left] + at) == _words(padded, order[left + 1] + at)
    return np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)


def later_strings(docs: np.ndarray, firsts: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of some pieces that also start earlier: document, first string and count of each run."""
    text = np.frombuffer(bytes([END]).join(contents) + bytes([END]), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    order = suffix_order(text)
    group = equal_runs(text, order)
    owner = np.searchsorted(begin, order, side="right") - 1
    whole = order + LENGTH <= begin[owner] + sizes[owner]
    order, owner, group = order[whole], owner[whole], group[whole]
    doc, start = docs[owner], firsts[owner] + order - begin[owner]
    by = np.lexsort((start, doc, group))
    group, doc, start, order = group[by], doc[by], start[by], order[by]
    if not len(group):
        return doc, start, start
    lead = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
    later = (doc != doc[head]) | (start != start[head])
    doc, start = doc[later], start[later]
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))) if len(doc) else by
    return doc[edge], start[edge], np.diff(np.append(edge, len(doc)))


def _numbered(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of documents in the order of id and text key, and the id and key of each number."""
    by = np.lexsort((keys, ids))
    new = np.ones(len(by), bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (keys[by][1:] != keys[by][:-1])
    numbers = np.empty(len(by), np.int64)
    numbers[by] = np.cumsum(new) - 1
    return numbers, ids[by][new], keys[by][new]


def _piece_rows(docs: DataFrame) -> DataFrame:
    """Pieces of all documents: ``route``, ``digest``, ``doc``, ``key``, ``first``, ``settled``.

    Of equal pieces in one slice only the first needs to meet others; the rest are settled here, as combining
    before a shuffle, so an anchor that is everywhere sends few rows. Settled rows are routed by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            numbers, ids, keys = _numbered(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for low, high in slices(texts):
                text, anchor, digest, first, _ = pieces(texts[low:high])
                doc = numbers[low:high][text]
                by = np.lexsort((first, doc, digest, anchor))
                anchor, digest, doc, first = anchor[by], digest[by], doc[by], first[by]
                if not len(by):
                    continue
                lead = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])))
                head = np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))
                settled = (doc != doc[head]) | (first != first[head])
                route = np.where(settled, mixed(mixed(ids[doc].view(np.uint64)) + keys[doc].view(np.uint64)), anchor).view(np.int64)
                columns = [route, digest.view(np.int64), ids[doc], keys[doc], first, settled]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["route", "digest", "doc", "key", "first", "settled"])

    return docs.mapInArrow(run, "route long, digest long, doc long, key long, first long, settled boolean")


def _settle(rows: DataFrame) -> DataFrame:
    """Streams rows in the order of route, digest, document and place; gives ``anchor`` (null for a settled piece),
    ``doc``, ``key``, ``first``, ``count``.

    A piece with an equal one before it is settled: all its strings start earlier elsewhere. The first of its
    digest is open if its anchor has other digests, and dropped if not. Of an anchor only two rows are remembered.
    """
    ordered = rows.repartition("route").sortWithinPartitions("route", "settled", "digest", "doc", "key", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # first row of the present anchor, as long as no other digest was seen
        last = None  # first row of the present digest
        for batch in batches:
            route, digest, doc, key, first = (batch.column(i).to_numpy() for i in range(5))
            settled = batch.column(5).to_numpy(zero_copy_only=False)
            n = len(route)
            if not n:
                continue
            new_route, new_digest = np.ones(n, bool), np.ones(n, bool)
            new_route[1:] = (route[1:] != route[:-1]) | settled[1:] | settled[:-1]
            new_digest[1:] = new_route[1:] | (digest[1:] != digest[:-1])
            head = np.maximum.accumulate(np.where(new_digest, np.arange(n), 0))
            head_doc, head_key, head_first = doc[head], key[head], first[head]
            goes_on = last is not None and not settled[0] and route[0] == last[0]
            if goes_on:
                new_route[0] = False
                if digest[0] == last[1]:
                    new_digest[0] = False
                    own = head == 0
                    head_doc[own], head_key[own], head_first[own] = last[2:]
            done = settled | (~new_digest & ((doc != head_doc) | (key != head_key) | (first != head_first)))
            # A digest's first row is open if its anchor had another digest before, or has one later.
            fresh = new_digest & ~settled
            other = fresh & ~new_route
            number = np.cumsum(new_route)
            several = np.bincount(number[other], minlength=number[-1] + 1) > 0
            opened = other | (fresh & new_route & several[number])
            out = [(route[opened], doc[opened], key[opened], first[opened], digest[opened])]
            if waiting is not None and goes_on and several[number[0]]:
                out.append(tuple(np.array([x]) for x in waiting))
                waiting = None
            if not goes_on or number[-1] != number[0]:
                waiting = None
            tail = np.flatnonzero(new_route & ~settled)
            if not settled[-1] and len(tail) and number[tail[-1]] == number[-1] and not several[number[-1]]:
                at = tail[-1]
                waiting = (route[at], doc[at], key[at], first[at], digest[at])
            if settled[-1]:
                last = waiting = None
            else:
                last = (route[-1], digest[-1], head_doc[-1], head_key[-1], head_first[-1])
            anchor, docs, keys, firsts, digests = (np.concatenate(x) for x in zip(*out, strict=True))
            columns = [
                pa.array(np.concatenate([anchor, route[done]]), mask=np.arange(len(anchor) + int(done.sum())) >= len(anchor)),
                pa.array(np.concatenate([docs, doc[done]])),
                pa.array(np.concatenate([keys, key[done]])),
                pa.array(np.concatenate([firsts, first[done]])),
                pa.array(np.concatenate([digests, digest[done]]) & 127),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc", "key", "first", "count"])

    return ordered.mapInArrow(run, "anchor long, doc long, key long, first long, count long")


def _cut_out(joined: DataFrame) -> DataFrame:
    """The bytes of open pieces: ``anchor``, ``doc``, ``key``, ``first``, ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3), strict=True):
                items = wanted.values
                anchor, first, count = items.field(0), items.field(1), items.field(2).to_pylist()
                content = [text[f : f + c + LENGTH - 1] for f, c in zip(first.to_pylist(), count, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [anchor, *(pa.array([x] * len(first), pa.int64()) for x in (number, key)), first, pa.array(content, pa.binary())],
                    names=["anchor", "doc", "key", "first", "content"],
                )

    return joined.mapInArrow(run, "anchor long, doc long, key long, first long, content binary")


def _compare(rows: DataFrame) -> DataFrame:
    """Runs of strings that start earlier under the same anchor, by suffix arrays over blocks of whole anchors."""
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, firsts, contents, size, last = [], [], [], [], 0, None

        def block() -> pa.RecordBatch:
            numbers, ids, texts = _numbered(np.array(docs, np.int64), np.array(keys, np.int64))
            number, *found = later_strings(numbers, np.array(firsts, np.int64), contents)
            for x in (docs, keys, firsts, contents):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[number], texts[number], *found)], names=["doc", "key", "first", "count"])

        for batch in batches:
            for anchor, doc, key, first, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and anchor != last:
                    yield block()
                    size = 0
                docs.append(doc)
                keys.append(key)
                firsts.append(first)
                contents.append(content)
                size, last = size + len(content), anchor
        if contents:
            yield block()

    return ordered.mapInArrow(run, "doc long, key long, first long, count long")


def _string_by_string(rows: DataFrame) -> DataFrame:
    """The same for anchors with many different pieces, so no task holds such an anchor as a whole.

    Pieces are cut in parts of ``PART`` strings. Equal parts are merged first, then the strings of what is left are
    compared one by one, each time by a digest whose earliest place is found by combining before the shuffle.
    """
    at = F.explode(F.sequence(F.lit(0), F.octet_length("content") - LENGTH, F.lit(PART)))
    parts = _with_earliest(rows.select("doc", "key", "first", "content", at.alias("at")), LENGTH + PART - 1, keep=True)
    later = _is_later()
    settled = parts.filter(later)
    leading = parts.filter(~later).select("doc", "key", F.col("start").alias("first"), F.col("string").alias("content"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("content") - LENGTH))
    strings = _with_earliest(leading.select("doc", "key", "first", "content", at.alias("at")), LENGTH).filter(later)
    found = [x.select("doc", "key", F.col("start").alias("first"), "count") for x in (settled, strings)]
    return found[0].union(found[1])


def _with_earliest(cut: DataFrame, size: int, keep: bool = False) -> DataFrame:
    """Strings of ``size`` bytes (fewer at the end) from ``at`` on, and where the earliest equal one is, if many are.

    Their bytes are shuffled only with ``keep``; comparing needs the digests alone.
    """
    string = F.substring("content", F.col("at") + 1, F.lit(size))
    rows = cut.select(
        "doc",
        "key",
        (F.col("first") + F.col("at")).alias("start"),
        (F.octet_length(string) - LENGTH + 1).cast("long").alias("count"),
        F.unhex(F.md5(string)).alias("digest"),
        *([string.alias("string")] if keep else []),
    )
    earliest = rows.groupBy("digest").agg(F.min(F.struct("doc", "key", "start")).alias("lead"), F.count(F.lit(1)).alias("n"))
    return rows.join(earliest.filter("n > 1").drop("n"), "digest", "left")


def _is_later() -> Column:
    return F.coalesce((F.col("doc") != F.col("lead.doc")) | (F.col("key") != F.col("lead.key")) | (F.col("start") != F.col("lead.start")), F.lit(False))


def _without_runs(joined: DataFrame, keep: bool) -> DataFrame:
    """Each document without the bytes its runs cover."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for number, text, runs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
                text = text or b""
                kept, at, removed, spans = [], 0, 0, 0
                if runs.is_valid and len(runs.values):
                    first, count = (runs.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(first, kind="stable")
                    begin = first[order]
                    end = np.minimum(np.maximum.accumulate(begin + count[order] + LENGTH - 1), len(text))
                    edge = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
                    for low, high in zip(begin[edge].tolist(), end[np.append(edge[1:], len(end)) - 1].tolist(), strict=True):
                        if low < high:
                            kept.append(text[at:low])
                            at, removed, spans = high, removed + high - low, spans + 1
                rest = b"".join([*kept, text[at:]])
                out.append((number, len(text), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if keep else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: bool = False, together: int = TOGETHER) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``keep``,
    the ``kept`` bytes. Removed is each byte in a string of ``LENGTH`` bytes that also starts earlier (in a document
    of smaller id, or earlier in the same one), judged on the texts as they came.

    Null and empty texts, and texts shorter than a string, lose nothing. A null id counts as the smallest. Different
    texts with one id are different documents, in the order of a hash of the text; rows that repeat id and text are
    one document. Other columns play no part; an empty table gives no rows.
    """
    number = F.coalesce(docs[f"`{doc_id}`"].cast("long"), F.lit(-(2**63)))
    source = docs.select(number.alias("doc"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("content"))
    source = source.select("doc", F.xxhash64("content").alias("key"), "content")
    rows = stored(_settle(_piece_rows(source)), "pieces")
    opened = rows.filter(F.col("anchor").isNotNull())
    many = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > together)
    many = many.select(F.col("anchor").alias("many"))
    opened = opened.join(many, F.col("anchor") == F.col("many"), "left")
    same = (F.col("doc") == F.col("of")) & (F.col("key") == F.col("of_key"))
    # The sign of the count tells the two ways apart.
    wanted = opened.select(F.col("doc").alias("of"), F.col("key").alias("of_key"), F.struct(F.when(F.col("many").isNull(), F.col("anchor")).alias("anchor"), "first", "count").alias("one"))
    wanted = wanted.groupBy("of", "of_key").agg(F.collect_set("one").alias("wanted"))
    bytes_of = _cut_out(source.join(wanted, same).select("doc", "key", "content", "wanted"))
    bytes_of = stored(bytes_of, "open")
    runs = _compare(bytes_of.filter(F.col("anchor").isNotNull())).union(_string_by_string(bytes_of.filter(F.col("anchor").isNull())))
    runs = rows.filter(F.col("anchor").isNull()).select("doc", "key", "first", "count").union(runs)
    runs = runs.groupBy(F.col("doc").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("first", "count")).alias("runs"))
    joined = source.join(runs, same, "left").select("doc", "content", "runs")
    result = _without_runs(joined, keep)
    return result.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
