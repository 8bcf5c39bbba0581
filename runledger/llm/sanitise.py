"""Removal of personal data, and of terms that give it away, with DataFrame functions only.

Patterns find the protected entities themselves. Terms that keep company with an entity disclose it: over the whole
texts of the corpus, the pointwise mutual information of term and entity, as a share of the information the entity
itself carries, says how much of it a reader learns from the term. Terms beyond a first threshold are generalised,
beyond a second one removed, wherever they stand, with the entity or without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import stored

# Kinds in the order they are listed. Possessive quantifiers and the look-behind (a match starts at the start of a
# run of its characters, or where the last match ended) change no match; they keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Without one of these a text has no match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SUPPORT = 3  # different texts a term and an entity share, at least
GENERALISE, REMOVE = 0.6, 0.9
TERM = r"[\p{L}][\p{L}\p{N}]{2,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, counted from the right with each second one doubled, sum to a multiple of ten."""
    backwards = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * (2 - i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        count = F.length(_digits(value))
        return F.when(count.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, hits: Column, pattern: str) -> Column:
    """Places of matches that were found in a text: ``begin``, ``end`` (code points, end exclusive), ``value``.

    What lies between the matches gives the distances.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("value"))
    none = F.array().cast("array<struct<begin:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("done"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + F.length(step["value"])
        one = F.struct(begin.alias("begin"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(one)).alias("done"))

    return F.aggregate(steps, start, add)["done"]


def _tagged(text: Column, number: int, kind: str) -> Column:
    """Entities of one kind, from the matches in the column of that kind."""
    good = F.filter(matches(text, F.col(f"__{kind}"), PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
    tagged = F.transform(
        good, lambda m: F.struct(F.lit(number).alias("kind"), m["begin"].alias("begin"), m["end"].alias("end"), m["value"].alias("value"))
    )
    none = F.array().cast("array<struct<kind:int,begin:int,end:int,value:string>>")
    return F.when(F.size(f"__{kind}") > 0, tagged).otherwise(none)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``found``: kind (its position in ``KINDS``), ``begin``, ``end`` and ``value`` of each entity of a text."""
    source = F.col(f"`{text}`")
    for kind in KINDS:
        maybe = F.contains(source, F.lit("@")) if kind == "email" else F.regexp_like(source, F.lit(HINTS[kind]))
        hits = F.regexp_extract_all(source, F.lit(PATTERNS[kind]), F.lit(0))
        docs = docs.withColumn(f"__{kind}", F.when(maybe, hits))
    lists = [_tagged(source, number, kind) for number, kind in enumerate(KINDS)]
    return docs.withColumn("found", F.concat(*lists)).drop(*[f"__{k}" for k in KINDS])


def _words(text: Column, found: Column) -> Column:
    """Different terms of a text outside its entities."""
    outside = F.when(F.size(found) > 0, _replaced(text, F.array_sort(F.transform(found, lambda e: F.struct(e["begin"].alias("begin"), e["end"].alias("end"), F.lit(" ").alias("label")))))).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def _places(text: Column, flagged: Column) -> Column:
    """Where terms that are keys of a map stand: ``begin``, ``end``, ``term``, ``action`` (the map's value)."""
    hits = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM, -1), lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("value"))
    none = F.array().cast("array<struct<begin:int,end:int,term:string,action:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("done"))

    def add(state: Column, step: Column) -> Column:
        begin, term = state["at"] + step["gap"], F.lower(step["value"])
        end, action = begin + F.length(step["value"]), F.try_element_at(flagged, term)
        one = F.struct(begin.alias("begin"), end.alias("end"), term.alias("term"), action.alias("action"))
        done = F.when(action.isNotNull(), F.concat(state["done"], F.array(one))).otherwise(state["done"])
        return F.struct(end.alias("at"), done.alias("done"))

    return F.when(flagged.isNotNull(), F.aggregate(steps, start, add)["done"]).otherwise(none)


def disclosing_terms(texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Terms that disclose an entity: ``entity``, ``term``, ``share`` (of the entity's information) and ``action``.

    ``texts`` has a row for each different text with its different ``terms`` and ``entities``. All texts count, also
    those without an entity. Counts combine before each shuffle.
    """
    total = texts.agg(F.count(F.lit(1)).alias("n"))
    counted = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    counted = stored(counted.filter(F.col("n_entity") >= support), "counted")
    terms = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = terms.filter(F.col("n_term") >= support)
    pairs = texts.select(F.explode("entities").alias("entity"), "terms").join(counted.select("entity"), "entity").select("entity", F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= support)
    joined = both.join(counted, "entity").join(terms, "term").withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    information = F.log(F.col("n") / F.col("n_entity"))
    shared = F.log(F.col("n") * F.col("n_both") / (F.col("n_term").cast("double") * F.col("n_entity")))
    share = F.when(information > 0, shared / information).otherwise(0.0)
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    found = joined.select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise)
    return found.withColumn("action", action)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per document: ``doc_id``, ``found`` (entities by kind and place) and ``terms`` (disclosing terms by
    place: ``begin``, ``end``, ``term``, ``action``; those inside an entity or over one are left out).

    Entities are looked for in whole texts; a null text is empty. Equal texts count once for the statistics. A term
    that discloses an entity is listed wherever it stands, in each document. Other columns play no part; an empty
    table gives no rows.
    """
    source = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("content"))
    base = base_spans(source, "content")

    doc = F.struct(F.col("doc_id").alias("id"), F.xxhash64("content").alias("text"))
    entities = F.array_distinct(F.transform("found", lambda e: F.concat_ws(":", e["kind"].cast("string"), F.lower(e["value"]))))
    base = base.select(doc.alias("doc"), _words(F.col("content"), F.col("found")).alias("terms"), entities.alias("entities"))
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "entities")
    # Of rows with one text the first counts; texts that stand alone need no join partner.
    copies = base.groupBy(F.col("doc.text").alias("copy")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies.filter("n > 1").select("copy", "first"), "copies")
    texts = base.join(copies, F.col("doc.text") == F.col("copy"), "left").filter("first is null or first = row")
    flagged = disclosing_terms(texts, support, generalise, remove)
    flagged = stored(flagged.groupBy("term").agg(F.max("action").alias("action")), "terms")
    own = base.select("doc", F.explode("terms").alias("term")).join(flagged, "term").distinct()
    own = own.groupBy(F.col("doc").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("flagged"))
    source = source.withColumn("doc", doc)
    joined = base_spans(source.join(own, F.col("doc") == F.col("of"), "left"), "content")
    joined = joined.select("doc", "found", _places(F.col("content"), F.col("flagged")).alias("terms"))
    clear = F.filter("terms", lambda t: ~F.exists("found", lambda e: (e["begin"] < t["end"]) & (t["begin"] < e["end"])))
    plain = F.transform("found", lambda e: F.struct(e["kind"].alias("kind"), e["begin"].alias("begin"), e["end"].alias("end"), e["value"].alias("value")))
    return joined.select(F.col("doc.id").alias("doc_id"), plain.alias("found"), clear.alias("terms"))


def spans_text(found: Column, terms: Column | None = None) -> Column:
    """Spans as ``kind:start:end`` by kind as listed and then place, comma-joined; terms come last."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(found, lambda e: F.concat_ws(":", names[e["kind"]], e["begin"].cast("string"), e["end"].cast("string")))
    if terms is not None:
        parts = F.concat(parts, F.transform(terms, lambda t: F.concat_ws(":", F.lit("term"), t["begin"].cast("string"), t["end"].cast("string"))))
    return F.array_join(parts, ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda e: e["kind"] == KINDS.index(kind))).cast("long")


def sanitised(text: Column, found: Column, terms: Column) -> Column:
    """The text with entities replaced by their kind, and terms by ``[TERM]`` or, beyond the second threshold, by
    nothing. Where spans overlap, the first one decides, up to its end."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    entity = F.transform(found, lambda e: F.struct(e["begin"].alias("begin"), e["end"].alias("end"), labels[e["kind"]].alias("label")))
    term = F.transform(
        terms, lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise("[TERM]").alias("label"))
    )
    return _replaced(text, F.array_sort(F.concat(entity, term)))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with ``spans`` (``begin``, ``end``, ``label``; in order) replaced by their labels."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(span["begin"] - state["at"], F.lit(0)))
        label = F.when(span["begin"] >= state["at"], span["label"]).otherwise("")
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["done"], gap, label).alias("done"))

    state = F.aggregate(spans, start, add)
    return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))
