"""Hashed text embedding: tokens and character trigrams in a fixed number of buckets.

An ``EmbeddingProvider`` maps (id, text) rows to (id, bucket, weight) rows of
unit length; another model plugs in as a function of the same shape, for
instance through ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh.functions.text import tokens
from pricemesh.session import spread

EmbeddingProvider = Callable[[DataFrame], DataFrame]


def bucket(feature: Column, dims: int = 512) -> Column:
    """First eight hex digits of md5, modulo ``dims``."""
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def word_buckets(toks: Column, dims: int = 512) -> Column:
    return F.transform(toks, lambda t: bucket(F.concat(F.lit("w:"), t), dims))


def gram_buckets(toks: Column, dims: int = 512) -> Column:
    grams = F.flatten(
        F.transform(
            toks,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.length(t)),
                lambda i: F.substring(F.concat(F.lit("#"), t, F.lit("#")), i, F.lit(3)),
            ),
        )
    )
    return F.transform(grams, lambda g: bucket(F.concat(F.lit("g:"), g), dims))


def bucket_weights(docs: DataFrame, key: str, toks: str, dims: int = 512) -> DataFrame:
    """Integer weights: 2 per token, 1 per trigram; repeats add up."""
    c = F.col
    features = F.concat(
        F.transform(word_buckets(c(toks), dims), lambda b: F.struct(b.alias("bucket"), F.lit(2).alias("w"))),
        F.transform(gram_buckets(c(toks), dims), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("w"))),
    )
    return (
        docs.select(key, F.explode(features).alias("f"))
        .groupBy(key, F.col("f.bucket").alias("bucket"))
        .agg(F.sum("f.w").alias("weight"))
    )


def hashed_embedding(docs: DataFrame) -> DataFrame:
    """Default provider: (id, text) -> (id, bucket, weight) with unit length; rows without an id have none.

    Rows are dealt by id over as many tasks as they need, so sums and lengths stay inside a task.
    """
    placed = spread(docs.select("id", "text").filter("id is not null"), "id")
    raw = bucket_weights(placed.select("id", tokens(F.col("text")).alias("toks")), "id", "toks")
    # At most one row per bucket and id.
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return raw.select("id", "bucket", (F.col("weight") / norm).alias("weight"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, clipped to [0, 1]."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b))))
