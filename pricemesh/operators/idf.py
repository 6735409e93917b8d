"""Inverse document frequencies over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(x: Column) -> Column:
    """Six decimals as an integer, so sums do not depend on row order."""
    return F.round(x * 1000000).cast("bigint")


def corpus_idf(docs: DataFrame, tokens: str, copies: str | None = None) -> DataFrame:
    """``1 + ln(N / df)`` per distinct token, as (token, df, idf_micros).

    ``copies`` names a column saying how many equal documents a row stands for.
    N is one number, read by a first small job.
    """
    weight = F.col(copies) if copies else F.lit(1)
    n = max(1, docs.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    df = (
        docs.select(F.explode(F.array_distinct(tokens)).alias("token"), weight.alias("_copies"))
        .groupBy("token")
        .agg(F.sum("_copies").cast("bigint").alias("df"))
    )
    return df.withColumn("idf_micros", micros(1 + F.log(F.lit(float(n)) / F.col("df"))))


def unseen_idf(token: Column) -> Column:
    """Weight of a token the corpus does not hold: digits tell more."""
    return F.when(token.rlike("[0-9]"), 3000000).otherwise(2000000).cast("bigint")
