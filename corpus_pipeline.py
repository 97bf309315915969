"""A training-data pipeline over the documents table.

Stages, each written as Parquet and read again by the next one:
toxicity (toxic documents go), quality rules (poor documents go), n-gram
Jaccard join (one document of each near-duplicate class stays), mixing of
sources to target weights (rows repeat as often as the mix takes them), and
SentencePiece encoding with its round trip.

Models are fitted on the labelled documents of the original table, on the
same folds as the queries of the operators, so their decisions agree.  Tables are
read by Spark from ``sf_dir`` and written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, piece_codec, quality_rules, toxicity
from tidemark.llm.labelled import fold_of
from tidemark.llm.registry import read
from tidemark.session import scratch_path

#: Weights of the sources in code-point order, repeating; null last.
MIX_WEIGHTS = (5.0, 2.0, 1.0)

#: Documents with this probability of toxicity, or more, go.
REJECT_TOXIC_AT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold_of(F.col("key"), 4) != 2)
    return toxicity.drop_toxic(docs, model, REJECT_TOXIC_AT)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model."""
    model = quality_rules.fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold_of(F.col("key"), 5) != 0)
    return quality_rules.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs, mixing.cycled_weights(MIX_WEIGHTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""
    return piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("ngram_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("piece_codec", encode),
]

#: The first stages are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored before the next stage reads it."""
    place = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
