"""Fingerprints, spelling variants and hard negatives against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import fingerprints, negatives, queries, spelling
from runledger.llm.jaccard import shingles

ODD = [None, "", " \n", "!?", "é", "two words", "x" * 30_000, "w1 w2 w3 w4 w5 " * 2_000]


def texts(seed: int, count: int = 50) -> list[str | None]:
    rng = random.Random(seed)
    out = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 150))) for _ in range(count)]
    near = [" ".join([*t.split()[:-1], "changed"]) for t in out[:15]]
    return [*out[:20], *near, *out[20:], *out[:5], *ODD, "emoji 😀 in a text of a few words", "end"]


def as_rows(spark, rows, extra=True):
    schema = "doc_id long, text string" + (", fingerprint string, part int, content string, run string" if extra else "")
    return spark.createDataFrame([(*r, "kept", 7, "x", "y") if extra else r for r in rows], schema).repartition(3)


def jaccard(a: str, b: str) -> float:
    one, other = (set(shingles([t.encode()])[0].tolist()) for t in (a, b))
    return len(one & other) / len(one | other) if one | other else 1.0


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_edited_texts(spark, parts):
    values = texts(1)
    # Ids with gaps, a null one, and one repeated with another text and with the same text.
    rows = [(None if i == 7 else i * 3, t) for i, t in enumerate(values)] + [(3, "an id again"), (9, values[3]), (9, values[3])]
    got = fingerprints.compare_with_next(as_rows(spark, rows), parts=parts).collect()
    assert len(got) == len(rows)
    hashes = {r.text: r.h for r in as_rows(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (name, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        want[name, len(text), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text: dict = {}
    for r in got:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * fingerprints.VALUES
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert len({by_text[9, len(values[3])][0].fingerprint, *(r.fingerprint for r in by_text[9, len(values[3])])}) == 1


def test_likeness_follows_similarity(spark):
    values = [t or "" for t in texts(2)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(as_rows(spark, list(enumerate(values)), False), parts=5).collect()}
    errors = []
    for i, text in enumerate(values):
        after, row = values[(i + 1) % len(values)], got[i]
        for other, near, exact in ((fingerprints.edited(text, after), row.near_edited, row.jaccard_edited), (after, row.near_next, row.jaccard_next)):
            assert exact is None or exact == jaccard(text, other)
            errors.append(abs(near - jaccard(text, other)))
            if jaccard(text, other) >= 0.8:
                assert exact is not None
    assert max(errors) < 0.25 and np.mean(errors) < 0.03
    assert got[len(values) - 1].near_next == 0 and len({got[i].fingerprint for i, t in enumerate(values) if t in ("", " \n", "!?")}) == 1


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.compare_with_next(as_rows(spark, []), parts=3).collect() == []
    alone = fingerprints.compare_with_next(as_rows(spark, [(5, "one two three four five six")]), parts=3).collect()
    assert [(r.doc_id, r.near_next, r.jaccard_next) for r in alone] == [(5, 1.0, 1.0)]
    same = fingerprints.compare_with_next(as_rows(spark, [(None, "same text")] * 40), parts=6).collect()
    assert len(same) == 40 and {r.near_next for r in same} == {1.0}


def test_near_duplicate_classes(spark):
    values = texts(3)
    got = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(as_rows(spark, list(enumerate(values)), False)).collect()}
    label = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if re.search(r"\w", a or "") and re.search(r"\w", b or "") and jaccard(a, b) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    assert fingerprints.near_duplicates(as_rows(spark, [], False)).count() == 0


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts: dict[str, int]) -> set[tuple]:
    out, form = [], {}
    for word, n in counts.items():
        near = sorted((-m, other) for other, m in counts.items() if one_edit(word, other))
        if near and -near[0][0] >= 10 * n:
            form[word] = near[0][1]
        out.append((word, n, len(near)))
    rows = set()
    for word, n, near in out:
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, near, counts.get(form.get(word))))
    return rows


@pytest.mark.parametrize("part", [spelling.PART, 5])
def test_variants(spark, part):
    rng, counts = random.Random(4), {"aaaaaaa": 4, "aaaaaaaa": 50, "aaaaaaaaa": 2, "z" * 3_000: 2, "z" * 2_999 + "y": 40}
    for _ in range(60):
        base = "".join(rng.choices("abcdéö", k=rng.randint(7, 12)))
        counts[base] = rng.choice([3, 40, 500, 5_000])
        for _ in range(6):
            at, letter = rng.randrange(len(base)), rng.choice("abcdé")
            other = rng.choice([base[:at] + base[at + 1 :], base[:at] + letter + base[at:], base[:at] + letter + base[at + 1 :]])
            if len(other) >= 7:
                counts.setdefault(other, rng.choice([2, 2, 4, 30, 400]))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame, part=part).collect()]
    assert len(got) == len(counts) and set(got) == plain_variants(counts)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_words_of_texts(spark):
    values = ["Bücher MÜSSEN BÜCHER können, lesbare", None, "", "ÀÉÎÕÜ÷×ab " * 40, "lesbare " * 3_000, "short words", "1234567 abcdefg8hijklmno", "é" * 9]
    rows = [*enumerate(values * 12), (None, "lesbare lesbare")]
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    frame = as_rows(spark, rows)
    got = {r.word: r.n for r in spelling.word_counts(frame, queries.misspelt()).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 2}
    assert spelling.variants(spelling.word_counts(frame.limit(0))).collect() == []
    # Short and rare words by brute force over all lengths.
    shown = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.word_counts(frame, queries.misspelt())).collect()}
    assert shown == plain_variants(got)


def plain_negatives(rows, anchors, positives=5, negatives_=10):
    used = []
    for name, label, vector in dict.fromkeys((n, x, None if v is None else tuple(v)) for n, x, v in rows):
        if name is None or label is None or not vector or any(c is None or not np.isfinite(c) for c in vector):
            continue
        used.append((name, label, np.floor(np.array(vector) * 256).astype(np.int64)))
    out = []
    for name, label, own in used:
        if not anchors(name):
            continue
        scored = sorted((-int(own @ v), i, x) for i, x, v in used if i != name and len(v) == len(own))
        for score, other, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives_]
            out += [(name, other, rank + 1, s[1], -score, -s[0]) for rank, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "spread"), [(8_192, 0.3), (40, 0.3), (40, 3.0)])
def test_hard_negatives(spark, block_rows, spread):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 4))
        rows.append((i, label, (np.round(centres[label] * 2 + rng.normal(size=6) * spread, 1)).tolist()))
    rows += [rows[3], (401, None, [1.0] * 6), (402, 1, None), (403, 1, [None] * 6), (404, 1, [float("nan")] * 6), (405, 2, [float("inf")] * 6)]
    rows += [(406, 2, [0.0] * 6), (410, 2, [0.0] * 6), (None, 1, [1.0] * 6), (407, 1, []), (420, 1, [1.0, 2.0]), (421, 2, [0.5, 0.8]), (422, 1, [1.0, 1.5])]
    rows += [(500 + i, 1, rows[10][2]) for i in range(90)] + [(600 + i, 2, rows[10][2]) for i in range(30)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, score int").repartition(3)
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"), block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda n: n % 10 == 0)
    assert negatives.mine(frame.limit(0), F.lit(True), F.col("label")).count() == 0


def test_lists_are_not_read_to_the_end():
    rng = np.random.default_rng(1)
    vectors = np.where(rng.random((3_000, 4)) < 0.02, rng.integers(300, 500, (3_000, 4)), rng.integers(-50, 50, (3_000, 4)))
    block = negatives.Block(np.arange(3_000), np.arange(3_000), ["a", "b"] * 1_500, vectors)
    anchor = np.array([200, -10, 5, 0])
    found, read = block.best(anchor, -1, "a", False, np.array([0]), np.array([1 << 60]), 10)
    scores = vectors[1::2] @ anchor
    want = sorted(zip((-scores).tolist(), range(1, 3_000, 2)))[:10]
    assert [(-s, r) for r, s in zip(*(x.tolist() for x in found[0]), strict=True)] == want
    assert read < 1_000


def test_large_products_are_exact():
    big = (1 << 25) + 1
    vectors = np.array([[big, big, 1], [big, big, 2], [big - 1, big, 3]])
    block = negatives.Block(np.arange(3), np.arange(3), ["b"] * 3, vectors)
    anchor = np.array([big, big, 1 << 20])
    assert block.scores(np.arange(3), anchor).tolist() == [sum(int(a) * int(b) for a, b in zip(v, anchor)) for v in vectors]
