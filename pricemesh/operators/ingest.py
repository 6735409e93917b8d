"""Keeping listings up to date: upsert of feed rows, stores, snapshots of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.functions.display import discount
from pricemesh.functions.stores import base_url, with_store
from pricemesh.functions.text import query_key, row_hash
from pricemesh.operators.asof import latest_before


def first_rows(rows: DataFrame, key: str = "listing_id", order: str = "position") -> DataFrame:
    """One row per key, the first by ``order``; pre-combined on the map side."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order, row_hash(rows, others))).alias("row"))
    return best.select(key, "row.*").select(*rows.columns)


def split_known(fresh: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known listings, rows of new listings)."""
    ids = listings.select("listing_id")
    return fresh.join(ids, "listing_id", "left_semi"), fresh.join(ids, "listing_id", "left_anti")


def refresh_prices(listings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known listings take price, mrp and discount from the feed and nothing else.

    ``fresh`` has one row per listing id (see ``first_rows``).
    """
    new = fresh.select("listing_id", F.col("price").alias("_price"), F.col("mrp").alias("_mrp"))
    joined = listings.join(new, "listing_id", "left")
    changed = F.col("_price").isNotNull()
    return (
        joined.withColumn(
            "discount_percentage",
            F.when(changed, discount(F.col("_price"), F.col("_mrp"))).otherwise(F.col("discount_percentage")),
        )
        .withColumn("price", F.coalesce("_price", "price"))
        .withColumn("mrp", F.coalesce("_mrp", "mrp"))
        .select(*listings.columns)
    )


def upsert(listings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Refreshed listings and the new ones; new ones never join an old product.

    One outer join does both: a listing takes price, mrp and discount of the feed row it meets
    (see ``refresh_prices``), and a feed row that meets none is a new listing.
    """
    c = F.col
    rows = first_rows(fresh)
    old = listings.select(F.struct(*[c(f"`{k}`") for k in listings.columns]).alias("_old"), c("listing_id").alias("_id"))
    new = rows.select(F.struct(*[c(f"`{k}`") for k in rows.columns]).alias("_new"), c("listing_id").alias("_new_id"))
    met = old.join(new, c("_id") == c("_new_id"), "full_outer")
    known, changed = c("_old").isNotNull(), c("_new.price").isNotNull()
    of_feed = lambda k: c("_new")[k] if k in rows.columns else F.lit(None)
    taken = {
        "price": F.coalesce("_new.price", "_old.price"),
        "mrp": F.coalesce("_new.mrp", "_old.mrp"),
        "discount_percentage": F.when(changed, discount(c("_new.price"), c("_new.mrp"))).otherwise(c("_old.discount_percentage")),
    }
    added = {"discount_percentage": discount(c("_new.price"), c("_new.mrp"))}
    return met.select(
        *[
            F.when(known, taken.get(k, c("_old")[k])).otherwise(added.get(k, of_feed(k))).alias(k)
            for k in listings.columns
        ]
    )


def new_stores(rows: DataFrame, stores: DataFrame, source: str = "seller_name", link: str = "product_url") -> DataFrame:
    """Stores not in the store table yet, with name, address and colour.

    One link per store gives the address: the smallest, so the choice is stable.
    """
    seen = with_store(rows, source)
    fresh = seen.groupBy(F.col("store_slug").alias("slug")).agg(
        F.min("store_name").alias("name"),
        F.min(F.nullif(F.col(link), F.lit(""))).alias("_link"),
        F.min("store_colour").alias("brand_color"),
    )
    return fresh.join(stores.select("slug"), "slug", "left_anti").select(
        "slug", "name", F.lit("").alias("logo_url"), base_url(F.col("_link")).alias("base_url"), "brand_color"
    )


def result_snapshot(rows: DataFrame, fetched_at: Column) -> DataFrame:
    """(query_key, product_ids in rank order, fetched_at) from rows with query, location, product_id, position."""
    ranked = rows.groupBy(query_key(F.col("query"), F.col("location")).alias("query_key"), "product_id").agg(
        F.min("position").alias("rank")
    )
    # Products of one query's result page.
    return ranked.groupBy("query_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]
        ).alias("product_ids"),
        fetched_at.alias("fetched_at"),
    )


def current_snapshots(snapshots: DataFrame, as_of: Column, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Latest snapshot per key and whether it is still fresh; stale ones serve when a feed fails."""
    latest = snapshots.groupBy("query_key").agg(
        F.max_by("product_ids", "fetched_at").alias("product_ids"), F.max("fetched_at").alias("fetched_at")
    )
    alive = F.col("fetched_at") > as_of - F.expr(f"interval {cfg.snapshot_hours} hours")
    return latest.withColumn("fresh", alive)


def served_snapshots(requests: DataFrame, snapshots: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """What each past request (query_key, asked_at, failed, ...) was served, by the snapshots of its own time.

    ``outcome``: ``fresh`` (the snapshot is young enough), ``fetch`` (the feed is
    asked again), ``stale`` (the feed failed, the old snapshot serves) or
    ``empty`` (the feed failed and there is none).  ``product_ids`` and
    ``fetched_at`` are those of the snapshot served, else null.
    """
    found = latest_before(requests, snapshots.select("query_key", "product_ids", "fetched_at"), "query_key", "asked_at", "fetched_at")
    alive = F.col("state.fetched_at") > F.col("asked_at") - F.expr(f"interval {cfg.snapshot_hours} hours")
    outcome = (
        F.when(F.coalesce(alive, F.lit(False)), "fresh")
        .when(~F.coalesce("failed", F.lit(False)), "fetch")
        .when(F.col("state").isNotNull(), "stale")
        .otherwise("empty")
    )
    served = F.col("outcome").isin("fresh", "stale")
    return (
        found.withColumn("outcome", outcome)
        .withColumn("product_ids", F.when(served, F.col("state.product_ids")))
        .withColumn("fetched_at", F.when(served, F.col("state.fetched_at")))
        .drop("state")
    )


def snapshot_products(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    """Products of each snapshot with their place; products that no longer exist drop out."""
    ids = snapshots.select("query_key", F.posexplode("product_ids").alias("place", "product_id"))
    return ids.join(products, "product_id")
