"""Writers: full rebuild of the catalog tables, history and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> None:
    """Replace a table.  The same input gives the same table again."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{folder}/{name}")


def write_build(build, folder: str) -> None:
    """Products, listings and pairs of a batch build.

    Products are partitioned by category, which searches and comparisons filter on.
    """
    write_table(build.products(), folder, "products", "category")
    write_table(build.membership(), folder, "listings")
    write_table(build.pairs, folder, "pairs", "match_type")


def write_statistics(idf: DataFrame, folder: str, version: int) -> None:
    """Keep corpus statistics as one version; writing a version again replaces it and no other."""
    idf.write.mode("overwrite").parquet(f"{folder}/statistics/version={version}")


def read_statistics(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(token, df, idf_micros) of a version, by default the newest; only its files are read."""
    every = spark.read.parquet(f"{folder}/statistics")
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).drop("version")


def append_history(searches: DataFrame, folder: str, now: Column) -> None:
    """Append (query trimmed, pincode, now)."""
    searches.select(
        F.regexp_replace("query", r"(?U)^\s+|\s+$", "").alias("query"), "pincode", now.alias("created_at")
    ).write.mode("append").parquet(f"{folder}/history")


def append_snapshots(snapshots: DataFrame, folder: str) -> None:
    snapshots.write.mode("append").parquet(f"{folder}/snapshots")


def marketplaces(stores: DataFrame) -> DataFrame:
    return stores.select("slug", "name", "logo_url", "base_url", "brand_color")
