"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it
again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, kernels, near_dedup, pieces, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 7 doesn't reject.

    It learns from sf_dir's documents and labels.  Every row is scored by its text alone: null and empty texts have the score of no evidence and stay,
    repeated rows stay or go together, a score of the cutoff goes.  No documents give none.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    return docs.where(toxicity.scorer(spark, model)("text") < toxicity.CUTOFF)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class of operator 9: the one of least doc_id, among those the one of least text hash.

    Null and empty texts are no near-duplicates and all stay; rows with a null doc_id are held against each other only.
    """
    return near_dedup.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark passages that operator 3 finds; those of which more than four fifths are passages go.

    Null and empty texts and documents without a passage pass unchanged; without a benchmark all do.  Repeated rows stay repeated.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the spans of operator 8 replaced; every row stays, null texts as they are."""
    return secrets.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs without the text, then n_tokens and the piece ids of operator 10; a null or empty text has none."""
    encoded = pieces.with_ids(docs, pieces.public_vocabulary())
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return encoded.select(*kept, F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("encode", encode_pieces),
]

#: SQL can't express the learned and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kernels.kept(stage(spark, docs, sf_dir), name)
    return docs
