"""Readers for the benchmark tables, and listings derived from them by Spark.

Anything with the listing columns can take their place (see ``adapters``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyword_scan(listings: DataFrame, query: str) -> DataFrame:
    """Rows whose title contains any word of the query."""
    words = [w for w in query.lower().split() if w]
    hit = reduce(lambda a, b: a | b, (F.lower("title").contains(w) for w in words), F.lit(False))
    return listings.filter(hit)


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per (part, supplier), with the part as the given product."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lead_days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))) % 8
    per_offer = lines.groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_extendedprice").alias("price"),
        F.max("l_extendedprice").alias("mrp"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("review_count"),
        F.min(lead_days).alias("lead_days"),
    )
    sellers = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_name", "n_name")
    )
    parts = table(spark, folder, "part")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return (
        per_offer.join(parts, p == F.col("p_partkey"))
        .join(sellers, s == F.col("s_suppkey"))
        .select(
            F.concat_ws("-", p, s).alias("listing_id"),
            (p * 1000000 + s).alias("position"),
            p.alias("product_id"),
            F.lower("n_name").alias("marketplace"),
            F.col("s_name").alias("seller_name"),
            F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" size "), F.col("p_size")).alias("title"),
            F.lit("").alias("description"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            "price",
            "mrp",
            F.lit("INR").alias("currency"),
            F.lit("").alias("image_url"),
            F.substring(F.md5("p_name"), 1, 16).alias("image_hash"),
            (1 + ((s * 7 + p) % 9) * 0.5).cast("double").alias("rating"),
            "review_count",
            F.when((p + 3 * s) % 13 == 0, 99).otherwise(F.col("lead_days")).alias("delivery_days"),
            F.when((p + s) % 11 == 0, "out_of_stock")
            .when((p + s) % 7 == 0, "low_stock")
            .otherwise("in_stock")
            .alias("availability"),
            F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("product_attributes"),
            F.lit("").alias("product_url"),
        )
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` as a catalog to be matched: one listing per part."""
    p = F.col("p_partkey")
    return spread(table(spark, folder, "part")).select(
        p.cast("string").alias("listing_id"),
        p.alias("position"),
        F.concat_ws("-", F.lit("store"), p % 7).alias("marketplace"),
        F.lit("").alias("seller_name"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" size "), F.col("p_size")).alias("title"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") + 10).alias("mrp"),
        F.lit("INR").alias("currency"),
        F.concat(F.lit("/img/"), p).alias("image_url"),
        F.substring(F.md5("p_name"), 1, 16).alias("image_hash"),
        (1 + (p % 9) * 0.5).cast("double").alias("rating"),
        (p * 7 % 1000).alias("review_count"),
        (p % 8).cast("int").alias("delivery_days"),
        F.lit("in_stock").alias("availability"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("product_attributes"),
        F.lit("").alias("product_url"),
    )
