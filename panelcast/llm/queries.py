"""Registered queries of the text and embedding operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    alignment,
    divergence,
    language,
    lattice,
    mixture,
    oracles,
    pieces,
    quality_prior,
    quality_rules,
    secrets,
    simhash,
    substring_dedup,
    suffix_family,
    toxicity,
)
from panelcast.llm.text import learned_fold

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def vocabulary(name: str) -> str:
    """The vocabulary file of a public tokenizer, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return vocabulary("piece_bpe_32k.model")


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = learned_fold(F.col("doc_id"), 3, 1)
    model = toxicity.fit_toxicity(docs, labels(spark, sf), ~held_out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf), piece_model(), digests=True)


@query
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf))
    digest = F.sha2("kept_text", 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", digest)


@query
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    return quality_prior.quality_posteriors(documents(spark, sf), labels(spark, sf), host, path)


@query
def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    found = secrets.scan_secrets(docs, secrets.infer_formats(docs))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


@query
def op7_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixture.mix_sources(documents(spark, sf))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return quality_rules.quality_rules(docs, quality_rules.fit_quality(docs, labels(spark, sf)))


@query
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = learned_fold(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs, ~held_out)
    found = language.predict_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_family.remove_repeated_bytes(documents(spark, sf))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query
def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_tokens(
        documents(spark, sf), vocabulary("byte_bpe_50k.json"), piece_model(), digests=True
    )


@query
def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
