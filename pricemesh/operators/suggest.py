"""Suggestions while typing: recent queries first, then product titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_suggestions(history: DataFrame, typed: str, recent: int = 50, shown: int = 5) -> DataFrame:
    """Latest queries containing the typed text, newest first, (text, place).

    A query is dropped when its lowered form was already shown as such; forms
    that differ only in case therefore stay.
    """
    text = typed.strip().lower()
    latest = history.orderBy(F.col("created_at").desc(), F.col("query")).limit(recent)
    matching = latest.filter(F.lower("query").contains(text)) if text else latest
    # ``recent`` rows at most from here on.
    lowered = matching.withColumn("lowered", F.lower("query"))
    plain = lowered.filter("query = lowered").groupBy("lowered").agg(F.max("created_at").alias("shown_at"))
    kept = (
        lowered.join(plain, "lowered", "left")
        .filter(
            F.col("shown_at").isNull()
            | (F.col("created_at") > F.col("shown_at"))
            | ((F.col("query") == F.col("lowered")) & (F.col("created_at") == F.col("shown_at")))
        )
        .select(F.col("query").alias("text"), "created_at")
    )
    return _placed(kept.orderBy(F.col("created_at").desc(), "text").limit(shown), [F.col("created_at").desc(), F.col("text")])


def product_suggestions(products: DataFrame, typed: str, shown: int = 8) -> DataFrame:
    """Titles containing the typed text, by title, (text, place)."""
    text = typed.strip().lower()
    if not text:
        hits = products.limit(0)
    else:
        hits = products.filter(F.lower("canonical_title").contains(text))
    titles = hits.select(F.col("canonical_title").alias("text"), "group_position")
    return _placed(titles.orderBy("text", "group_position").limit(shown), [F.col("text"), F.col("group_position")])


def _placed(few: DataFrame, order) -> DataFrame:
    """Number a handful of rows."""
    from pyspark.sql import Window

    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("text", "place")


def merged_suggestions(history: DataFrame, products: DataFrame, shown: int = 8) -> DataFrame:
    """History first, then products the history does not already name."""
    new = products.join(history.select("text"), "text", "left_anti")
    rows = history.select("text", F.lit(0).alias("source"), "place").unionByName(
        new.select("text", F.lit(1).alias("source"), "place")
    )
    few = rows.orderBy("source", "place").limit(shown)
    return _placed(few, [F.col("source"), F.col("place")])
