"""Comparison of the offers of each product: cheapest, fastest, ranges, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh.functions.display import discount
from pricemesh.operators.sorting import listing_key


def with_discount(listings: DataFrame) -> DataFrame:
    return listings.withColumn("discount_percentage", discount(F.col("price"), F.col("mrp")))


def rollup(listings: DataFrame, by: list[str], sort: str = "price_asc", key: Column | None = None) -> DataFrame:
    """One row per group.  Ties follow the listing order of ``sort``, or the struct ``key``.

    Offers are first combined per store, then per group: both steps combine on
    the map side, so a group with very many offers costs no single task.
    """
    c = F.col
    available = c("availability") != "out_of_stock"
    known = c("delivery_days") < 90
    offer = F.struct("listing_id", "price", "marketplace", "delivery_days")
    key = listing_key(sort) if key is None else key

    def best(condition: Column, order: Column) -> Column:
        return F.min(F.when(condition, F.struct(order.alias("order"), offer.alias("offer"))))

    cheap_key = F.struct((~available).alias("missing"), c("price").alias("price"), key.alias("key"))
    fast_key = F.struct(c("delivery_days").alias("days"), c("price").alias("price"), key.alias("key"))
    per_store = listings.groupBy(*by, "marketplace").agg(
        best(F.lit(True), cheap_key).alias("cheap"),
        best(available & known, fast_key).alias("fast_available"),
        best(known, fast_key).alias("fast_any"),
        F.max(available).alias("any_available"),
        F.max(F.when(available & known, c("delivery_days"))).alias("slow_available"),
        F.max(F.when(known, c("delivery_days"))).alias("slow_any"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.min("rating").alias("rating_min"),
        F.max("rating").alias("rating_max"),
        F.max("discount_percentage").alias("discount_max"),
        F.count("*").alias("listing_count"),
        F.min("position").alias("group_position"),
        F.min(key).alias("first"),
    )
    merged = per_store.groupBy(*by).agg(
        F.min("cheap").alias("cheap"),
        F.min("fast_available").alias("fast_available"),
        F.min("fast_any").alias("fast_any"),
        F.max("any_available").alias("any_available"),
        F.max("slow_available").alias("slow_available"),
        F.max("slow_any").alias("slow_any"),
        F.min("price_min").alias("price_min"),
        F.max("price_max").alias("price_max"),
        F.min("rating_min").alias("rating_min"),
        F.max("rating_max").alias("rating_max"),
        F.max("discount_max").alias("discount_max"),
        F.count("*").alias("store_count"),
        F.sum("listing_count").alias("listing_count"),
        F.min("group_position").alias("group_position"),
        # One entry per store, so the array is as long as the store list at most.
        F.array_sort(F.collect_list(F.struct("first", "marketplace"))).alias("stores"),
    )
    # Without any available offer the comparison runs over all of them.
    fastest = F.when(c("any_available"), c("fast_available")).otherwise(c("fast_any"))["offer"]
    slowest = F.when(c("any_available"), c("slow_available")).otherwise(c("slow_any"))
    return merged.select(
        *by,
        c("cheap.offer.listing_id").alias("cheapest_listing"),
        c("cheap.offer.price").alias("cheapest_price"),
        c("cheap.offer.marketplace").alias("cheapest_store"),
        fastest["listing_id"].alias("fastest_listing"),
        fastest["delivery_days"].alias("fastest_days"),
        fastest["marketplace"].alias("fastest_store"),
        "price_min", "price_max", "rating_min", "rating_max", "discount_max",
        F.coalesce(slowest, F.lit(0)).alias("slowest_days"),
        "store_count", "listing_count", "group_position",
        F.transform("stores", lambda s: s["marketplace"]).alias("marketplaces"),
    )


def compare_chosen(chosen: DataFrame, listings: DataFrame, sort: str = "price_asc") -> DataFrame:
    """Compare chosen sets: ``chosen`` holds (request_id, listing_id)."""
    return rollup(chosen.join(listings, "listing_id"), ["request_id"], sort)


def images_in_order(listings: DataFrame, by: list[str], sort: str = "price_asc") -> DataFrame:
    """Distinct images per group, in listing order, one row per image with its rank."""
    first = listings.groupBy(*by, "image_url").agg(F.min(listing_key(sort)).alias("first"))
    from pricemesh.operators.sorting import rank_within

    return rank_within(first, by, [F.col("first").asc()], "image_rank").drop("first")


def facets(results: DataFrame, by: list[str]) -> DataFrame:
    """Stores and brands among the results, sorted, and the number of stores."""
    stores = results.groupBy(*by, "marketplace", "brand").count().groupBy(*by).agg(
        F.array_sort(F.collect_set("marketplace")).alias("stores"),
        F.array_sort(F.collect_set(F.nullif("brand", F.lit("")))).alias("brands"),
    )
    return stores.withColumn("n_stores", F.size("stores").cast("bigint"))


def totals(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by).agg(
        F.count("*").alias("total_groups"), F.sum("listing_count").alias("total_listings")
    )


def delivery_estimates(requests: DataFrame, listings: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """(marketplace, listing_id) -> days and availability; unknown marketplaces are rejected."""
    known = requests.join(marketplaces.select(F.col("slug").alias("marketplace")), "marketplace", "left_semi")
    found = listings.select("marketplace", "listing_id", "delivery_days", "availability")
    return known.join(found, ["marketplace", "listing_id"], "left").select(
        "marketplace",
        "listing_id",
        F.coalesce("delivery_days", F.lit(5)).alias("delivery_days"),
        F.coalesce(F.col("availability") != "out_of_stock", F.lit(False)).alias("available"),
    )
