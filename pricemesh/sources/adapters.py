"""Stores that plug into one catalog: each says how it is read, the union looks like one table of listings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.operators.ingest import first_rows
from pricemesh.schemas import LISTING


@dataclass(frozen=True)
class StoreAdapter:
    """``read`` returns the store's rows in any columns; those of a listing that it lacks are null."""

    slug: str
    read: Callable[[SparkSession], DataFrame]

    def listings(self, spark: SparkSession) -> DataFrame:
        """The listing columns, cast to their declared types; ``marketplace`` is the store's slug as a constant."""
        rows = self.read(spark).drop("marketplace").withColumn("marketplace", F.lit(self.slug))
        declared = spark.createDataFrame([], LISTING).schema
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared
        ])


def union_stores(spark: SparkSession, stores: Iterable[StoreAdapter]) -> DataFrame:
    """One catalog out of many stores, empty without any; two stores with one slug are refused.

    Filters reach every store's own scan, and since ``marketplace`` is constant
    in each, a filter on it removes the other stores from the plan unread.
    """
    named = list(stores)
    slugs = [s.slug for s in named]
    if len(set(slugs)) < len(slugs):
        raise ValueError(f"Stores with one slug: {sorted({s for s in slugs if slugs.count(s) > 1})}")
    return reduce(DataFrame.unionByName, (s.listings(spark) for s in named), spark.createDataFrame([], LISTING))


def point_lookup(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """The listing of every (marketplace, listing_id) asked for, all columns null where there is none.

    One row per distinct request; of several rows with one id the first by
    position answers.  A request without store or id finds nothing.
    """
    key = ["marketplace", "listing_id"]
    asked = requests.select(*key).distinct()
    met = listings.join(asked, key, "left_semi").withColumn("_key", F.struct(*key))
    return asked.join(first_rows(met, "_key").drop("_key"), key, "left")
