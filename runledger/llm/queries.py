"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.llm import decontaminate, fingerprints, jaccard, language, mixing, negatives, neighbours, placement, sanitise, spelling, suffixes, tokens, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(table(spark, sf_dir, "documents"))
    entities, terms = F.col("found"), F.col("terms")
    return found.select(
        "doc_id",
        *[sanitise.count_of(entities, kind).alias(f"n_{kind}") for kind in sanitise.KINDS],
        F.sha2(sanitise.spans_text(entities), 256).alias("base_sha256"),
        sanitise.spans_text(entities, terms).alias("spans"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(spark, table(spark, sf_dir, "pages"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return placement.place(docs, F.col("doc_id"), SHARDS)


def op4_sql() -> str:
    """The same table as text; the digest and the look-up are DuckDB's."""
    owners = placement.fill_table(SHARDS)
    slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {placement.TABLE_SIZE})::INT"
    return f"""
WITH owners AS (SELECT '{",".join(map(str, owners))}'.split(',') AS owner),
  placed AS (SELECT doc_id, {slot} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 3, '0') AS shard FROM placed, owners"""


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_filter(docs, train=F.coalesce(~held_out(), F.lit(True)))
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


# A tree of three levels: the domain is a source's number modulo 3 (4 where it has none).
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 7


def mix_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1)
    domain = number.try_cast("int") % 3
    return {"domain": F.coalesce(domain, F.lit(4)), "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> dict[str, Column]:
    """Targets: domains 5 : 3 : 2, in each English as much as all others together, sources alike."""
    return {
        "domain": F.element_at(F.array(*[F.lit(x) for x in (5.0, 3.0, 2.0, 1.0, 1.0)]), F.col("domain") + 1),
        "lang": F.when(F.col("lang") == "en", 3.0).otherwise(1.0),
        "source": F.lit(1.0),
    }


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mix_levels(), mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def misspelt() -> Column:
    """A run of letters, without one code point in about every 31st document that it is in."""
    run = F.col("run")
    number = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    at = (number % F.length(run)).cast("int")
    return F.when(number % 31 == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspelt()))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH rows AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  ranked AS (
    SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same
      AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_pii,
        op3_warc,
        op4_sharding,
        op5_language_id,
        op6_token_files,
        op7_jaccard_join,
        op8_mixing,
        op9_suffixes,
        op10_neighbours,
        op11_fingerprints,
        op12_spelling,
        op13_hard_negatives,
    )
}

def _filled(nodes: str, parents: str, order: str) -> str:
    """SQL that deals budgets to children; by bisection on the level, unlike the operator's closed form."""
    same = " AND ".join(f"n.{p} IS NOT DISTINCT FROM l.{p}" for p in parents.split(", ")) if parents else "true"
    keys = f"{parents}, " if parents else ""
    return f"""
  {order}_level AS (
    SELECT {keys}any_value(budget) AS budget, 0.0::DOUBLE AS lo, (max(room / weight) + 1)::DOUBLE AS hi, 0 AS it
    FROM {nodes} {f"GROUP BY {parents}" if parents else ""}
    UNION ALL
    SELECT {", ".join("l." + p for p in parents.split(", ")) + ", " if parents else ""}any_value(l.budget),
           CASE WHEN sum(least(room, (lo + hi) / 2 * weight)) < any_value(l.budget) THEN any_value((lo + hi) / 2) ELSE any_value(lo) END,
           CASE WHEN sum(least(room, (lo + hi) / 2 * weight)) < any_value(l.budget) THEN any_value(hi) ELSE any_value((lo + hi) / 2) END,
           it + 1
    FROM {order}_level l JOIN {nodes} n ON {same} WHERE it < 80
    GROUP BY {", ".join("l." + p for p in parents.split(", ")) + ", " if parents else ""}it),
  {order}_share AS (
    SELECT n.*, least(room, hi * weight) AS share FROM {nodes} n JOIN {order}_level l ON {same} AND it = 80)"""


def mix_sql(share: float, epochs: int, seed: int) -> str:
    place = f"('0x' || substr(md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE rows AS MATERIALIZED (
    SELECT * FROM (
      SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 3, 4)::INT AS domain,
             lang, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens FROM documents)
    WHERE n_tokens > 0),
  leaves AS MATERIALIZED (
    SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {epochs})::DOUBLE AS room FROM rows GROUP BY ALL),
  n1 AS MATERIALIZED (
    SELECT domain, sum(room) AS room, [5.0, 3.0, 2.0, 1.0, 1.0][domain + 1]::DOUBLE AS weight,
           (SELECT sum(tokens) * {share}::DOUBLE FROM leaves) AS budget FROM leaves GROUP BY domain),
  {_filled("n1", "", "d1").strip()},
  n2 AS MATERIALIZED (
    SELECT l.domain, lang, sum(l.room) AS room, CASE WHEN lang = 'en' THEN 3.0 ELSE 1.0 END::DOUBLE AS weight, any_value(share) AS budget
    FROM leaves l JOIN d1_share s ON l.domain = s.domain GROUP BY l.domain, lang),
  {_filled("n2", "domain", "d2").strip()},
  n3 AS MATERIALIZED (
    SELECT l.domain, l.lang, source, l.room, 1.0::DOUBLE AS weight, share AS budget
    FROM leaves l JOIN d2_share s ON l.domain = s.domain AND l.lang IS NOT DISTINCT FROM s.lang),
  {_filled("n3", "domain, lang", "d3").strip()},
  budgets AS MATERIALIZED (
    SELECT l.*, floor(share + 1e-6)::BIGINT AS take FROM leaves l JOIN d3_share s
      ON l.domain = s.domain AND l.lang IS NOT DISTINCT FROM s.lang AND l.source IS NOT DISTINCT FROM s.source),
  turns AS (
    SELECT r.*, b.tokens, b.take, unnest(range(0, ceil(b.take / b.tokens)::BIGINT))::INT AS epoch
    FROM rows r JOIN budgets b ON r.domain = b.domain AND r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source
    WHERE b.take > 0),
  started AS (
    SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
      ORDER BY {place}, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM turns)
SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, take - start)::BIGINT AS taken
FROM started WHERE start < take"""


ORACLES: dict[str, str] = {
    "op4_sharding": op4_sql(),
    "op8_mixing": mix_sql(MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op13_hard_negatives": OP13_SQL,
}
