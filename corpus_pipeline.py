"""A training-text pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.llm import fmindex, jaccard, langid, pieces, toxicity
from pricemesh.llm.common import table, written
from pricemesh.llm.queries import LANGUAGE, TOXICITY, fold


#: Share of the best language in the scores of all; at one half it outweighs the others together.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score at least the threshold; learns from the labelled documents of three of four folds.

    Where these teach nothing (no usable label, or labels of one class only), no document is rejected.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold(4) != 2)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", TOXICITY)
    return toxicity.drop_toxic(docs, "text", model, TOXICITY.threshold)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which no language can be told: those without a letter, also where no language is learned,
    and those whose best language is no likelier than all others together.
    """
    model = langid.train(docs.filter(fold(3) != 1), "text", "lang", LANGUAGE)
    return langid.keep_known(docs, "text", model, LEAST_LANGUAGE_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.one_of_each(docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which benchmark windows cover at least one word in twenty."""
    return fmindex.drop_contaminated(docs, "text", table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the bytes each piece stands for."""
    done = pieces.encode_pieces(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), decode=False)
    return done.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "begins", "ends")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("jaccard", one_of_each),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: No stage but the join is within SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
