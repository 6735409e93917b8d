"""Offers of further stores for known products.

Every offer row gets a verdict; the verdicts drive the update, the insert and
the notes, so each of them is one pass over the same table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.functions.delivery import delivery_note, with_delivery_days
from pricemesh.functions.display import discount, is_converted_price, number_or
from pricemesh.functions.identity import with_identity
from pricemesh.functions.stores import with_store

_COMPARED = ("storage", "ram", "colour", "condition")


def enrichable(products: DataFrame, listings: DataFrame, done: DataFrame) -> DataFrame:
    """(product_id, page_token) of products not enriched yet; a null token means none is known."""
    open_products = products.select("product_id").join(done.select("product_id"), "product_id", "left_anti")
    tokens = listings.filter(F.coalesce("page_token", F.lit("")) != "").groupBy("product_id").agg(
        F.min_by("page_token", F.struct("position", "listing_id")).alias("page_token")
    )
    return open_products.join(tokens, "product_id", "left")


def bases(listings: DataFrame) -> DataFrame:
    """Per product: the listing placed first in the feed, and the lowest price."""
    place = F.struct(F.coalesce("position", F.lit(99.0)), "listing_id")
    base = listings.groupBy("product_id").agg(
        F.min_by(F.struct("title", "image_url"), place).alias("base"), F.min("price").alias("lowest_price")
    )
    return base.select("product_id", F.col("base.title").alias("base_title"), F.col("base.image_url").alias("base_image"), "lowest_price")


def judged(offers: DataFrame, listings: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Offers of known products with ``verdict``: ok or the reason to skip."""
    c = F.col
    # A product's own title is read once, not once per offer.
    based = with_identity(bases(listings), "base_title", "_base")
    based = based.withColumn("_base", F.struct(*[c(f"_base.{k}").alias(k) for k in _COMPARED]))
    rows = with_store(offers, "name").join(based, "product_id")
    rows = with_identity(rows.withColumn("_offer_title", F.coalesce("title", F.lit(""))), "_offer_title", "_offer")
    rows = rows.withColumn("price", number_or(c("extracted_price")))
    ratio = F.greatest("price", "lowest_price") / F.greatest(F.lit(1.0), F.least("price", "lowest_price"))
    other = reduce(
        lambda p, q: p | q,
        (F.coalesce(c(f"_offer.{k}") != c(f"_base.{k}"), F.lit(False)) for k in _COMPARED),
    )
    no_link = (F.coalesce("link", F.lit("")) == "") | (c("price") == 0) | is_converted_price(c("price"))
    verdict = (
        F.when(c("listed_slug").isNull(), "not a main store")
        .when(no_link, "no link/price or foreign")
        .when(ratio > cfg.price_ratio, "price too far")
        .when((c("_offer_title") != "") & other, "different variant")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).drop("_offer", "_base", "_offer_title")


def linked(judged_offers: DataFrame, listings: DataFrame) -> DataFrame:
    """(listing_id, price, product_url) for the first listing of a store: its last valid offer wins."""
    first = with_store(listings.select("product_id", "seller_name", "position", "listing_id"), "seller_name").groupBy(
        "product_id", "store_slug"
    ).agg(F.min_by("listing_id", F.struct("position", "listing_id")).alias("listing_id"))
    last = judged_offers.filter("verdict = 'ok'").groupBy("product_id", "store_slug").agg(
        F.max_by(F.struct("price", "link"), "offer_order").alias("offer")
    )
    return last.join(first, ["product_id", "store_slug"]).select(
        "listing_id", F.col("offer.price").alias("price"), F.col("offer.link").alias("product_url")
    )


def added(judged_offers: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """New listings for stores the product did not have: the first valid offer wins."""
    c = F.col
    stores = with_store(listings.select("product_id", "seller_name"), "seller_name").select("product_id", "store_slug").distinct()
    new = judged_offers.filter("verdict = 'ok'").join(stores, ["product_id", "store_slug"], "left_anti")
    kept = [x for x in new.columns if x not in ("product_id", "store_slug")]
    first = new.groupBy("product_id", "store_slug").agg(
        F.min_by(F.struct(*kept), "offer_order").alias("offer")
    ).select("product_id", "store_slug", "offer.*")
    said = F.filter(
        "details_and_offers", lambda o: F.lower(o).rlike("deliver|arrives|shipping")
    )
    lined = first.withColumn("_line", F.coalesce(F.nullif(F.get(said, 0), F.lit("")), "shipping"))
    mrp = F.greatest("price", number_or(c("extracted_original_price"), c("price")))
    return with_delivery_days(lined, "_line", as_of).select(
        F.concat_ws("-", F.lit("s"), "product_id", "store_slug").alias("listing_id"),
        "product_id",
        c("store_slug").alias("marketplace"),
        c("name").alias("seller_name"),
        F.coalesce(F.nullif("title", F.lit("")), "base_title").alias("title"),
        "price",
        mrp.alias("mrp"),
        discount(c("price"), mrp).alias("discount_percentage"),
        c("base_image").alias("image_url"),
        number_or(c("rating")).alias("rating"),
        number_or(c("reviews")).cast("bigint").alias("review_count"),
        "delivery_days",
        delivery_note(c("_line")).alias("delivery_text"),
        F.lit("in_stock").alias("availability"),
        c("link").alias("product_url"),
    )


def apply_links(listings: DataFrame, links: DataFrame) -> DataFrame:
    """Set the store link and price; mrp and discount stay as they were."""
    new = links.select("listing_id", F.col("price").alias("_price"), F.col("product_url").alias("_url"))
    return (
        listings.join(new, "listing_id", "left")
        .withColumn("price", F.coalesce("_price", "price"))
        .withColumn("product_url", F.coalesce("_url", "product_url"))
        .select(*listings.columns)
    )


def notes(judged_offers: DataFrame, listings: DataFrame) -> DataFrame:
    """Per product: offers returned, linked and added, and the skip reasons with their counts."""
    stores = with_store(listings.select("product_id", "seller_name"), "seller_name").select("product_id", "store_slug").distinct()
    known = judged_offers.join(stores.withColumn("_known", F.lit(True)), ["product_id", "store_slug"], "left")
    ok = F.col("verdict") == "ok"
    linked_now = F.count_if(ok & F.col("_known").isNotNull())
    per_store = known.groupBy("product_id", "store_slug").agg(
        F.count("*").alias("offers"), linked_now.alias("linked"),
        F.max((ok & F.col("_known").isNull()).cast("bigint")).alias("added"),
        *[
            F.count_if(F.col("verdict") == reason).alias(name)
            for name, reason in (
                ("not_listed", "not a main store"), ("no_link", "no link/price or foreign"),
                ("price_far", "price too far"), ("other_variant", "different variant"),
            )
        ],
    )
    counts = ("offers", "linked", "added", "not_listed", "no_link", "price_far", "other_variant")
    return per_store.groupBy("product_id").agg(*[F.sum(k).alias(k) for k in counts])


def skipped(judged_offers: DataFrame) -> DataFrame:
    """Offers left out, in offer order, in the words of the notes."""
    price = F.format_string("%s: price %.1f too far from %.1f", "name", "price", "lowest_price")
    variant = F.concat("name", F.lit(": different variant ("), "title", F.lit(")"))
    said = (
        F.when(F.col("verdict") == "price too far", price)
        .when(F.col("verdict") == "different variant", variant)
        .otherwise(F.concat(F.coalesce("name", F.lit("Store")), F.lit(": "), "verdict"))
    )
    return judged_offers.filter("verdict <> 'ok'").select("product_id", "offer_order", said.alias("note"))
