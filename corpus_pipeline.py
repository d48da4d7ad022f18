"""The corpus pipeline: documents through five operators, each stage written and read again.

Stages, in order: quality rules (rejected documents go), SimHash near-duplicates (one document of
each group stays), secret scans (secrets are masked), mixing to target weights (documents are left out
or repeated), SentencePiece encoding and decoding (the final token counts and digests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import mixture, pieces, quality_rules, secrets, simhash
from panelcast.llm.queries import piece_model
from panelcast.operators.lineage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the model keep.

    Null and empty texts fail. Repeated rows are judged alike; a null id is kept. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_rules.fit_quality(docs, labels)
    judged = quality_rules.quality_rules(docs, model, keep=COLUMNS)
    return judged.filter("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Near-duplicates are linked by SimHash fingerprints of three-word shingles that differ in at most two bits.
    Of rows that share that id, the one with the smallest hash of its text stays; rows that share an id but
    are no near-duplicates are in groups of their own. Rows without an id cannot be told apart and stay.
    Null and empty texts are near-duplicates of each other. An empty table gives an empty one.
    """
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    known = marked.filter("doc_id is not null")
    found = simhash.near_duplicates(
        known, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS, keep=["__hash"]
    )
    best = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "__hash")).alias("best"))
    best = best.select("best.*").distinct()
    # copies of one row are alike but for the other columns; the least of them stays
    one = known.groupBy("doc_id", "__hash").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    )
    kept = one.join(best, ["doc_id", "__hash"], "left_semi").select("doc_id", "row.*")
    return kept.union(docs.filter("doc_id is null").select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark.

    A null text stays null. Repeated rows and null ids are kept; an empty table gives an empty one.
    """
    model = secrets.infer_formats(docs)
    scanned = secrets.scan_secrets(docs, model, keep=["lang", "source"], redact=MASK)
    return scanned.select(
        "doc_id",
        F.col("redacted").alias("text"),
        "lang",
        "source",
        F.length("redacted").cast("bigint").alias("n_chars"),
    )


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a last part holds the words of its selected blocks only.

    Texts without words go. Repeated rows are rows of their own, null ids and sources are kept; an empty table
    gives an empty one.
    """
    return mixture.apply_mix(docs, COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, per row.

    Null texts count as empty. Rows stay as many as they are; an empty table gives an empty one.
    """
    return pieces.encode_pieces(docs, piece_model(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("mixing_sources", mixture_stage),
    ("sentencepiece", encoding_stage),
]

# The model of the first stage is trained; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written as Parquet and reread.

    Whole texts pass, however long. The stages say what nulls, repeated rows and empty tables give.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
