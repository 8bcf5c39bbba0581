"""From raw documents to token files: five stages, each an operator's decision over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.llm import decontaminate, jaccard, language, mixing, queries, tokens
from runledger.llm.common import shared_folder

# A document is rejected as no language if fewer of its n-grams are known to the best language.
LEAST_KNOWN = 0.2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose n-grams fit no language."""
    model = language.fit_filter(docs)
    found = language.identify(docs, model)
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_share") >= LEAST_KNOWN)
    return found.filter(kept).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return jaccard.keep_first(docs, jaccard.jaccard_join(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items)
    return found.filter(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, at most once each; the one that a leaf's budget cuts stays whole."""
    chosen = mixing.mix(docs, queries.mix_levels(), queries.mix_weights(), queries.MIX_SHARE, 1, queries.MIX_SEED)
    chosen = chosen.select(F.col("doc_id").alias("__chosen")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("__chosen")), "left_semi")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept documents in files of equal-length sequences, read back."""
    return tokens.token_table(spark, docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_files", token_files),
]

# Language filters, automata and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
