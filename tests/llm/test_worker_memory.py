"""What a Python worker holds at once is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.classic.dataframe import DataFrame

from runledger.llm import common, decontaminate, jaccard, language, queries, tokens


def test_pieces_are_learnt_in_small_parts():
    encoder = tokens.Encoder(queries.tokenizer_path(), 1)
    library, sizes = encoder.tokenizer, []

    class Spy:
        def encode(self, text, **options):
            sizes.append(text.count("\n") + 1)
            return library.encode(text, **options)

        def __getattr__(self, name):
            return getattr(library, name)

    encoder.tokenizer = Spy()
    texts = [" ".join(f"w{chr(97 + i % 26)}{i * 7919 % 100_003:x}q don't" for i in range(20_000)), "", "été 12"]
    ids, counts = encoder.encode([t.encode() for t in texts])
    assert sizes and max(sizes) <= 4096
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_texts_of_a_block_are_hashed_in_slices():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))).encode() for _ in range(2000)]
    texts += [None, b"", b"two words"]
    jaccard.shingles(texts[:10])
    tracemalloc.start()
    code, counts = jaccard.sliced_shingles(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = jaccard.shingles(texts)
    assert (code == whole[0]).all() and (counts == whole[1]).all() and counts[-3:].tolist() == [0, 0, 1]
    # Four megabytes of text; hashed at once they took over 200.
    assert most < 120 << 20
    assert jaccard.sliced_shingles([])[1].tolist() == []


def test_texts_go_to_the_workers_once(spark, monkeypatch):
    rows = [(1, "one two three four", "en", "old"), (2, None, "en", "old"), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, hit_items string")
    items = spark.createDataFrame([("a", "two three"), ("b", "four")], "item_id string, text string")
    model = language.fit_filter(docs)
    sent, given = [], []
    plain = DataFrame.mapInArrow

    def spy(self, func, schema, *rest):
        sent.append(self.columns)
        given.append([f.name for f in schema.fields])
        return plain(self, func, schema, *rest)

    monkeypatch.setattr(DataFrame, "mapInArrow", spy)
    found = decontaminate.decontaminate(docs, items)
    assert sent.pop() == ["doc_id", "text", "lang"]
    assert found.columns == ["doc_id", "text", "lang", "n_words", "hit_spans", "hit_items", "n_hit", "contaminated"]
    assert {r.doc_id: (r.text, r.lang, r.hit_items, r.n_hit) for r in found.collect()} == {
        1: (rows[0][1], "en", ["a", "b"], 3),
        2: (None, "en", [], 0),
        3: ("", None, [], 0),
    }
    # Where the texts are not asked for, the last pass does not give them back.
    for most in (decontaminate.AUTOMATON_WORDS, 1):
        given.clear()
        found = decontaminate.decontaminate(docs, items, keep=["doc_id"], automaton_words=most)
        assert "__source" not in given[-1] and all(len(names) < 4 for names in sent), (sent, given)
        assert {r.doc_id: (r.hit_items, r.n_hit) for r in found.collect()} == {1: (["a", "b"], 3), 2: ([], 0), 3: ([], 0)}
    sent.clear()
    cut = decontaminate.decontaminate(docs.withColumnRenamed("text", "kept_text"), items, text="kept_text", cut=True)
    assert {r.doc_id: r.kept_text for r in cut.collect()} == {1: "one ", 2: None, 3: ""}
    sent.clear()
    assert language.identify(docs, model).columns == [*docs.columns, "lang_pred", "lang_score", "lang_share"]
    assert sent == [docs.columns]


def test_columns_added_to_texts_of_other_kinds(spark):
    docs = spark.createDataFrame([(1, "é b"), (2, None)], "doc_id long, text string").withColumn("raw", F.col("text").cast("binary"))
    docs = docs.withColumn("__text", F.lit("own"))
    fields = [T.StructField("n", T.LongType())]

    def work(texts):
        return {"n": [len(t or b"") for t in texts], "text": [len(t or b"") for t in texts]}

    for text, keep in (("text", None), ("raw", None), ("TEXT", None), ("text", ["doc_id"])):
        found = common.add_columns(docs, text, fields, work, keep)
        assert found.columns == [*(docs.columns if keep is None else keep), "n"]
        assert {r.doc_id: r.n for r in found.collect()} == {1: 4, 2: 0}
        if keep is None:
            assert {r.doc_id: r["__text"] for r in found.collect()} == {1: "own", 2: "own"}
    over = common.add_columns(docs, "text", [T.StructField("text", T.LongType())], work)
    assert {r.doc_id: r.text for r in over.collect()} == {1: 4, 2: 0}


def test_texts_of_a_batch_are_taken_in_slices():
    texts = [None if i % 100 == 7 else b"" if i % 100 == 8 else b"x" * (3000 + i % 50) for i in range(10_000)]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    cuts, same = [], True
    for begin, end, part in common.text_slices(column):
        same &= part == texts[begin:end]
        cuts.append((begin, end))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same and cuts == list(common.slices(texts, common.PART_BYTES)) and cuts[-1][1] == len(texts)
    # 30 MB of text; as one list they would take that.
    assert most < 8 << 20
    assert list(common.text_slices(pa.array([], pa.string()))) == []
    assert list(common.text_slices(pa.array([None, "é"]))) == [(0, 2, [None, "é".encode()])]


def test_arrays_of_a_step_are_small(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(2000)]
    model = language.LanguageFilter.build(["a"], [language.grams([t.encode() for t in texts[:50]])[0]])
    column = pa.array(texts)
    for work in (model.predict, lambda part: jaccard._sketch(part, True)):
        work([b"warm up"])
        tracemalloc.start()
        for _, _, part in common.text_slices(column):
            work(part)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Over slices of a megabyte they took about four times as much.
        assert most < 40 << 20, most


def test_shares_of_languages_need_no_worker(spark, monkeypatch):
    """The small table of languages is a local relation, not an RDD that Python workers of another kind serve."""
    made = []
    plain = type(spark).createDataFrame

    def spy(self, *args, **options):
        made.append(plain(self, *args, **options))
        return made[-1]

    docs = spark.createDataFrame([("one two", "en"), ("eins zwei", "de"), ("x", None), (None, "en")], "text string, lang string")
    monkeypatch.setattr(type(spark), "createDataFrame", spy)
    assert language.fit_filter(docs).languages == ["de", "en"]
    assert made[0].dtypes == [("number", "int"), ("lang", "string"), ("share", "double"), ("least", "int"), ("texts", "double")]
    assert "LocalRelation" in made[0]._jdf.queryExecution().optimizedPlan().toString()
