"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import decontaminate, jaccard, language, mixing, neighbours, placement, sanitise, suffixes, tokens, warc
from runledger.llm.common import words
from runledger.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", "   \n", "é", "x" * 30_000]


def texts(seed: int, count: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(count)]
    near = [t.replace(t.split()[len(t.split()) // 2], "changed", 1) for t in out[:20]]
    return [*out, *near, *out[:5], *ODD]


def table(spark, values, extra=True):
    rows = [(i, t, "src0" if i % 3 else None, "kept") for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    return (df if extra else df.select("doc_id", "text")).repartition(3)


def test_decontamination(spark):
    values = texts(1)
    items = [("a", " ".join(values[0].split()[3:30])), ("b", "w1 w2"), ("c", None), ("d", "!?"), ("a", values[2]), (None, "w3"), ("e", "x" * 30_000)]
    frame = spark.createDataFrame(items, "item_id string, text string")

    def brute(text):
        run, hit, found = words((text or "").encode()), set(), set()
        for name, item in items:
            own = words((item or "").encode())
            size = min(13, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if name and own else set()
            for at in range(len(run) - size + 1):
                if tuple(run[at : at + size]) in grams:
                    hit |= set(range(at, at + size))
                    found.add(name)
        return len(run), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(run)

    for most in (decontaminate.AUTOMATON_WORDS, 5):
        got = decontaminate.decontaminate(table(spark, values), frame, automaton_words=most, cut=True)
        assert got.columns.count("n_words") == 1
        for row in got.collect():
            assert (row.n_words, row.n_hit, row.hit_items, row.contaminated) == brute(values[row.doc_id]), (most, row.doc_id)
            assert (row.kept_text is None) == (values[row.doc_id] is None)
    assert decontaminate.decontaminate(table(spark, values), frame.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(table(spark, values).limit(0), frame).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data(spark):
    values = [
        "a@b.c@d.e x_a@b-c.d..e@f.g. é😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004",
        "4111 1111 1111 1111 4111-1111-1111-11111 +1 (234) 567-8901. ++49 30 123 456 78) +1.2",
        "a" * 20_000 + "@bb.c", "a@b" + ".c" * 5_000, "1 " * 9_000, "+1" + "-" * 9_000, *ODD,
    ]
    got = sanitise.find(table(spark, values)).select("doc_id", sanitise.spans_text(F.col("found")).alias("spans")).collect()
    assert len(got) == len(values)
    for row in got:
        text = values[row.doc_id] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text) if passes(k, m[0])]
        assert row.spans == ",".join(want), text[:60]
    assert sanitise.find(table(spark, values).limit(0)).count() == 0


def test_disclosing_terms(spark):
    filler = [f"plain{i} talk about other{i} things mail u{i}@x.org today" for i in range(40)]
    telling = [f"the heiress{i % 2} Zanzibar castle{i} owner is rich@castle.org they say nr{i}" for i in range(6)]
    docs = table(spark, filler + telling + telling[:1])
    found = sanitise.find(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert all({t.term for t in rows[i].terms} >= {"zanzibar", "owner"} for i in range(40, 47))
    assert all(not rows[i].terms for i in range(40))
    clean = docs.join(found, "doc_id").select(sanitise.sanitised(F.col("text"), F.col("found"), F.col("terms")).alias("t")).collect()
    assert not [r.t for r in clean if "@" in r.t or "Zanzibar" in r.t]


def test_disclosing_terms_in_whole_texts(spark):
    """Shares are counted over all texts, and terms are found far from an entity and in texts without it."""
    far = " ".join(["und"] * 60)
    telling = [f"Zanzibar nr{i} {far} the common rich@castle.org {far} 王国的秘密 castle{i}" for i in range(6)]
    plain = [f"the common word{i} {far}" for i in range(40)] + [f"mail u{i}@x.org now{i}" for i in range(40)]
    docs = table(spark, [*telling, *plain, "no mail but ZANZIBAR here"])
    rows = {r.doc_id: [(t.begin, t.end, t.term, t.action) for t in r.terms] for r in sanitise.find(docs).collect()}
    for i, text in enumerate(telling):
        at = text.index("王")
        assert rows[i] == [(0, 8, "zanzibar", "remove"), (at, at + 5, "王国的秘密", "remove")]
    assert rows[86] == [(12, 20, "zanzibar", "remove")]
    assert not any(rows[i] for i in range(6, 86))


def test_archives(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u\r\nx", ""), (4, "u", None), (5, "é", "ü" * 50_000), (None, "n", "<p>a</p>"), (2, None, "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/warc"
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert len(got) == len(rows)
    heads = {}
    for page, _, html in rows:
        if page is not None:
            heads[html or ""] = max(heads.get(html or "", 0), page)
    for row in got:
        page = None if row.page_id is None else int(row.page_id)
        html = next(h or "" for p, _, h in rows if p == page)
        assert row.payload_bytes == len(html.encode()) and row.payload_digest == warc.digest(html.encode())
        revisit = page is not None and heads[html] != page
        assert (row.record_type, row.refers_to) == (("revisit", str(heads[html])) if revisit else ("response", None))
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0
    assert [m[3] for m in warc.coalesced(iter([("f", 0, 5), ("f", 5, 5), ("f", 100, 5), ("g", 0, 1)]), gap=10)] == [[(0, 5), (5, 5)], [(100, 5)], [(0, 1)]]


def test_lookup_table(spark):
    shards = [f"s{i}" for i in range(7)]
    owners = placement.fill_table(shards, 1009)
    sizes = np.bincount(owners)
    assert sizes.max() - sizes.min() <= 1
    fewer = placement.fill_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(owners, fewer, strict=True)) < 1.6 * sizes[6]
    # Turn by turn over whole preference lists.
    free, at, want = set(range(1009)), dict.fromkeys(range(7), 0), {}
    prefer = {
        i: [(placement._number(f"start:s{i}") + j * (placement._number(f"step:s{i}") % 1008 + 1)) % 1009 for j in range(1009)] for i in range(7)
    }
    while free:
        for i in range(7):
            if free:
                slot = next(s for s in prefer[i] if s in free)
                free.discard(slot)
                want[slot] = i
    assert owners == [want[s] for s in range(1009)] and at
    placed = placement.place(spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, shard string"), F.col("k"), shards, 1009).collect()
    assert len(placed) == 3 and len({r.shard for r in placed if r.k == 1}) == 1
    with pytest.raises(ValueError):
        placement.fill_table(shards, 1000)


def test_language(spark):
    rng = random.Random(4)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["stra", "ung", "ver"], "zz": ["çé", "ñu", "pè"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(40)), k) for i, k in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit_filter(docs, train=~held)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == k for i, _, k in test]) > 0.97
    assert all(0 <= r.lang_score <= 1 and 0 <= r.lang_share <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é" * 9)], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    empty = language.fit_filter(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    marks = spark.createDataFrame([(1, "² ½ Ⅷ"), (2, "² x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(marks, model).orderBy("doc_id").collect()] == [True, False]
    # The bits of an n-gram are those of all languages that have it.
    known = [np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(50, 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    masks = language.LanguageFilter.build(["a", "b"], known).masks(known[0])
    assert all(masks & np.uint64(1)) and all(masks[50:] & np.uint64(2)) and (masks[:50] & np.uint64(2)).sum() < 8


def test_many_languages(spark):
    """Seventy languages, repeated rows and a clashing column: masks and counts as by sets of n-grams."""
    rng = random.Random(5)
    rows = []
    for number in range(70):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(3)]
        rows += [(f"l{number:02d}", " ".join("".join(rng.choices(parts, k=3)) for _ in range(20)), 1.0) for _ in range(10)]
    docs = spark.createDataFrame(rows + rows[:10] * 30, "lang string, text string, lang_score double").repartition(4)
    model = language.fit_filter(docs, foreign=0.0)
    grams: dict[str, dict[bytes, set]] = {}
    for lang, text, _ in rows:
        padded = f" {text} ".encode()
        for at in range(len(padded) - 3):
            if 32 not in padded[at + 1 : at + 3]:
                grams.setdefault(lang, {}).setdefault(padded[at : at + 4], set()).add(text)
    known = [set(g for g, of in grams[name].items() if len(of) >= 1) for name in model.languages]
    assert len(model.languages) == 70 and model.slots.shape[1] == 2
    every = sorted(set().union(*known))
    hashes = language.mixed(np.array([int.from_bytes(g, "big") for g in every], np.uint64))
    masks = model.masks(hashes)
    got = np.stack([(masks[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1) for n in range(70)], 1).astype(bool)
    want = np.array([[g in known[n] for n in range(70)] for g in every])
    assert got[want].all() and got[~want].mean() < 0.01
    found = language.identify(docs, model)
    assert found.columns.count("lang_score") == 1
    found = found.collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    answers = {}
    for r in found:
        assert answers.setdefault(r.text, (r.lang_pred, r.lang_score)) == (r.lang_pred, r.lang_score)


def test_tokens(spark, tmp_path):
    values = [*texts(5), "it's I'LL <|endoftext|> x  é İ Σ", "".join(map(chr, range(1, 0x240)))]
    encoder = tokens.Encoder(tokenizer_path(), 1)
    folder = f"file://{tmp_path}/tokens"
    index = tokens.write_sequences(table(spark, values), tokenizer_path(), folder)
    got = {r.doc_no: r for r in tokens.read_sequences(index, folder).collect()}
    start = 0
    for i, text in enumerate(values):
        ids = [*encoder._encode([text or ""])[0], 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc), i
        start += len(ids)
    name = index.first()["file"]
    ids, mask = tokens.SequenceFile(folder, name).sequence(0)
    assert len(ids) == len(mask) == tokens.LENGTH and mask[0]
    empty = tokens.write_sequences(table(spark, values).limit(0), tokenizer_path(), f"{folder}-none")
    assert tokens.read_sequences(empty, folder).count() == 0


def test_jaccard(spark):
    values = texts(6)
    shingle = {}
    for i, text in enumerate(values):
        run = words((text or "").encode())
        shingle[i] = frozenset(tuple(run[k : k + 5]) for k in range(max(1, len(run) - 4))) if run else None
    root = {i: i for i in shingle}
    for a in shingle:
        for b in range(a):
            if shingle[a] and shingle[b] and len(shingle[a] & shingle[b]) >= 0.8 * len(shingle[a] | shingle[b]):
                old, new = sorted((root[a], root[b]))[::-1]
                root = {k: new if v == old else v for k, v in root.items()}
    got = jaccard.jaccard_join(table(spark, values))
    assert {r.doc_id: r.class_id for r in got.collect()} == root
    kept = jaccard.keep_first(table(spark, values), got)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert jaccard.jaccard_join(table(spark, values).limit(0)).count() == 0
    assert all(b > a for (_, a), (_, b) in zip(jaccard.fewest_matches(0.8, 1e-6), jaccard.fewest_matches(0.8, 1e-6)[1:], strict=False))


def test_jaccard_keeps_every_link_of_large_groups(spark, monkeypatch):
    """Chains and crowds of different near copies: links are those of brute force, in one block and in many."""
    rng = random.Random(8)
    base = rng.choices(WORDS, k=150)
    values = []
    for i in range(160):
        words_ = list(base)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            words_[at] = f"v{rng.randint(0, 9)}"
        values.append(" ".join(words_))
    values += texts(9, 30) + values[:10]
    shingle = [frozenset(zip(*(words((t or "").encode())[k:] for k in range(5)), strict=False)) for t in values]
    different = set(shingle) - {frozenset()}
    links = {s: sum(5 * len(s & o) >= 4 * len(s | o) for o in different if o != s) for s in different}
    for most in (jaccard.BLOCK_BYTES, 100_000):
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", most)
        monkeypatch.setattr(jaccard, "TILE_SETS", 128 if most > 100_000 else 17)
        got = {r.doc_id: r for r in jaccard.jaccard_join(table(spark, values)).collect()}
        long = [i for i, t in enumerate(values) if len(words((t or "").encode())) >= 5]
        assert {i: got[i].n_links for i in long} == {i: links[shingle[i]] for i in long}
        root = {}
        for i in long:
            seen, todo = {shingle[i]}, [shingle[i]]
            while todo:
                s = todo.pop()
                more = [o for o in different - seen if 5 * len(s & o) >= 4 * len(s | o)]
                seen.update(more)
                todo.extend(more)
            root[i] = min(k for k in long if shingle[k] in seen)
        assert {i: got[i].class_id for i in long} == root


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 5 == 0], f"s{i % 3}") for i in range(300)] + [(900, None, "a", "s0"), (901, "", None, None), (902, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": F.when(F.col("lang") == "b", 5.0).otherwise(1.0), "source": F.lit(1.0)}
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    got = mixing.mix(docs, levels, weights, 0.7, 2).collect()
    taken = sum(r.taken for r in got)
    assert 0.7 * total - 12 <= taken <= 0.7 * total
    have = sum(len((t or "").split()) for _, t, k, _ in rows if k == "b")
    # The heavy language runs out after two epochs; its shortage goes to the others.
    assert sum(r.taken for r in got if r.lang == "b") == 2 * have
    assert all(0 < r.taken <= r.n_tokens for r in got)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert sum(r.taken < r.n_tokens for r in got) <= 8
    assert mixing.mix(docs.limit(0), levels, weights, 0.7, 2).count() == 0


def test_suffixes(spark):
    values = [*texts(7, 40), "x" * 99, "x" * 100, "ab" * 300, "é" * 80, "é" * 80]
    seen = {}
    for i, text in enumerate(values):
        data = (text or "").encode()
        for s in range(len(data) - 99):
            seen.setdefault(data[s : s + 100], (i, s))
    for together in (suffixes.TOGETHER, 2):
        got = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, values), together=together).collect()}
        for i, text in enumerate(values):
            data = (text or "").encode()
            gone = bytearray(len(data))
            for s in range(len(data) - 99):
                if seen[data[s : s + 100]] != (i, s):
                    gone[s : s + 100] = b"\1" * 100
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(data), sum(gone), hashlib.sha256(kept).hexdigest()), i
            assert got[i].n_spans == len(re.findall(b"\1+", bytes(gone)))
    assert suffixes.remove_repeats(table(spark, values).limit(0)).count() == 0


def test_suffixes_of_repeated_ids(spark):
    """Different texts under one id, or without id, keep all bytes that no other text has."""
    rng = random.Random(11)
    fresh = lambda n: "".join(rng.choices("abcdefghij", k=n))
    shared = fresh(300)
    rows = [(1, shared), *[(None, fresh(700)) for _ in range(4)], *[(5, fresh(700)) for _ in range(4)]]
    rows += [(5, shared + fresh(400)), (5, fresh(200) + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for together in (suffixes.TOGETHER, 1):
        got = suffixes.remove_repeats(docs, together=together, keep=True).collect()
        want = [(i, (t.replace(shared, "") if i == 5 else t).encode()) for i, t in rows]
        assert sorted((r.doc_id or 0, bytes(r.kept)) for r in got) == sorted((i or 0, t) for i, t in want)


def test_suffix_order():
    rng = random.Random(8)
    for trial in range(30):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 200))) * (1 + trial % 2) + b"\xff"
        order = suffixes.suffix_order(np.frombuffer(text, np.uint8), 16).tolist()
        assert sorted(order) == list(range(len(text)))
        assert [text[i : i + 16] for i in order] == sorted(text[i : i + 16] for i in order)


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1500, 16)).round(3)
    vectors[200:320] = vectors[200]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0).toPandas()
    hits = total = 0
    for query, own in got.groupby("query_id"):
        far = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
        far[query] = np.inf
        want = np.lexsort((np.arange(len(far)), far))[:10]
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 10
        assert np.allclose(own.sort_values("rank").score, np.sort(own.score)) and len(own) == 10
    assert total == 150 and hits >= 0.9 * total
    few = neighbours.search(frame.filter("vec_id < 4"), F.col("vec_id") == 0).toPandas()
    assert list(few["rank"]) == [1, 2, 3]
    assert neighbours.search(frame.limit(0), F.col("vec_id") == 0).count() == 0


def _nearest(vectors, ids, query, k=10):
    """Ids of the ``k`` nearest of a query by brute force, each id once."""
    far = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
    best = {}
    for one, distance in zip(ids, far, strict=True):
        if one != ids[query]:
            best[one] = min(distance, best.get(one, np.inf))
    return sorted(best, key=lambda i: (best[i], i))[:k]


def test_neighbours_in_many_lists(spark):
    """Lists fitted for a high recall lose next to no neighbour."""
    vectors = np.random.default_rng(3).normal(size=(1500, 32)).round(3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0, lists=200, recall=0.999).toPandas()
    hits = sum(len(set(_nearest(vectors, range(1500), q)) & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert got.query_id.nunique() == 15 and hits >= 0.99 * 150


def test_neighbours_look_at_few_lists(spark, monkeypatch):
    """Queries that were not fitted on find 95 of 100 neighbours in a fifth of the lists."""
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(12, 32))[rng.integers(0, 12, 12_000)] * 0.7 + rng.normal(size=(12_000, 32))).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")
    looked, routed = [], neighbours._routed

    def counting(rows, graph, most, ratio, base=1):
        out = routed(rows, graph, most, ratio, base)
        if rows.columns[0] == "query_id":
            looked.append((out.count(), len(graph.value.centroids)))
        return out

    monkeypatch.setattr(neighbours, "_routed", counting)
    monkeypatch.setattr(neighbours, "FITTED", 100)
    got = neighbours.search(frame, F.col("vec_id") % 50 == 0).toPandas()
    own = {q: set(part.vec_id) for q, part in got.groupby("query_id")}
    hits = sum(len(set(_nearest(vectors.astype(float), range(12_000), q)) & own[q]) for q in range(0, 12_000, 50))
    assert len(own) == 240 and hits >= 0.95 * 2_400
    assert len(looked) == 1 and looked[0][0] <= 0.2 * 240 * looked[0][1]


def test_neighbours_of_odd_tables(spark):
    """Vectors of another length take no part; columns with the names of the result do no harm."""
    rows = [(i, [float(i), 1.0], 7, "x") for i in range(20)] + [(100, [1.0], 7, "x"), (200, [1.0, 2.0, 3.0], 7, "x"), (0, [0.0, 1.0], 7, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query string")
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, i, i, float(i)) for i in range(1, 11)]


def test_neighbours_of_repeated_rows(spark):
    """Repeats of an id take no place of other ids."""
    vectors = np.random.default_rng(4).normal(size=(300, 8)).round(3)
    ids = list(range(300))
    near = _nearest(vectors, ids, 0)[0]
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)] * 2 + [(near, vectors[near].tolist())] * 60
    rows += [(near, (vectors[near] + 1e-6 * j).tolist()) for j in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0, lists=4, recall=1.0).toPandas()
    for query in (0, 100, 200):
        assert got[got.query_id == query].sort_values("rank").vec_id.tolist() == _nearest(vectors, ids, query)
