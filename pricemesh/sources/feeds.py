"""Feed rows to listings: shopping results and one marketplace's own results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.config import RuleConfig
from pricemesh.functions.delivery import delivery_note, with_delivery_days
from pricemesh.functions.display import is_converted_price, number_or
from pricemesh.functions.stores import with_store
from pricemesh.session import filter_here

FEED_LISTING = [
    "query_id", "listing_id", "marketplace", "seller_name", "title", "description", "price", "mrp",
    "image_url", "rating", "review_count", "delivery_days", "delivery_text", "availability",
    "position", "page_token", "feed_link", "product_url", "direct",
]


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _or(c: Column, default: Column) -> Column:
    """Empty counts as missing."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def page_token() -> Column:
    """First of two token fields, else the token in an address's query string."""
    in_url = F.try_parse_url("serpapi_immersive_product_api", F.lit("QUERY"), F.lit("page_token"))
    return F.coalesce(
        F.nullif("immersive_product_page_token", F.lit("")), F.nullif("page_token", F.lit("")), in_url, F.lit("")
    )


def _common(df: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    priced = df.withColumn("_price", number_or(c("extracted_price"))).withColumn("_title", _strip(c("title")))
    # Read before the filter: the code between two filters is one method, and one too long is never compiled.
    read = priced.select(
        "*",
        F.greatest("_price", number_or(c("extracted_old_price"), c("_price"))).alias("mrp"),
        F.coalesce("thumbnail", F.lit("")).alias("image_url"),
        number_or(c("rating")).alias("_rating"),
        number_or(c("reviews")).alias("_reviews"),
        delivery_note(c("delivery_line")).alias("delivery_text"),
        F.lit("in_stock").alias("availability"),
    ).drop("price", "rating", "page_token", "title", "extracted_price", "extracted_old_price", "thumbnail", "reviews")
    valid = filter_here(read, (c("_price") != 0) & ~is_converted_price(c("_price")) & (c("_title") != ""))
    counted = with_delivery_days(valid, "delivery_line", as_of).withColumn("review_count", c("_reviews").cast("bigint"))
    return counted.drop("_reviews").withColumnsRenamed({"_price": "price", "_rating": "rating", "_title": "title"})


def shopping_listings(rows: DataFrame, as_of: Column) -> DataFrame:
    """Shopping results: only listed stores and rupee prices without a fraction."""
    c = F.col
    shown = F.coalesce("price", F.lit("₹"))
    rupees = shown.contains("₹") | F.lower(shown).contains("rs")
    token = rows.withColumn("_token", page_token()).withColumn("_source", _strip(c("source")))
    listed = filter_here(
        with_store(filter_here(token, rupees).withColumn("delivery_line", c("delivery")), "_source"),
        (c("_source") != "") & c("listed_slug").isNotNull(),
    )
    mapped = _common(listed, as_of)
    pid = _or(c("product_id"), F.substring(F.md5(F.concat("title", "_source")), 1, 16))
    listing_id = F.concat_ws("-", F.lit("g"), pid, "store_slug", F.substring(F.md5(F.lower("title")), 1, 8))
    return mapped.select(
        "query_id",
        listing_id.alias("listing_id"),
        c("store_slug").alias("marketplace"),
        c("_source").alias("seller_name"),
        "title",
        F.coalesce("snippet", F.lit("")).alias("description"),
        "price", "mrp", "image_url", "rating", "review_count", "delivery_days", "delivery_text", "availability",
        F.coalesce(F.nullif("position", F.lit(0)), F.lit(vocab.UNKNOWN_DELIVERY_DAYS)).cast("double").alias("position"),
        c("_token").alias("page_token"),
        F.coalesce("product_link", F.lit("")).alias("feed_link"),
        F.lit("").alias("product_url"),
        F.lit(False).alias("direct"),
    )


def marketplace_listings(rows: DataFrame, as_of: Column, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """The marketplace's own results: unsponsored rows with direct links.

    Positions get a half added, so the rows interleave after the shopping
    results.  ``cfg.second_feed_rows`` limits the rows per query where it is set.
    """
    c = F.col
    first = rows.filter(~F.coalesce("sponsored", F.lit(False)))
    if cfg.second_feed_rows is not None:
        ordered = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), "title")
        first = first.withColumn("_n", F.row_number().over(ordered)).filter(c("_n") <= cfg.second_feed_rows)
    told = F.filter("delivery", lambda d: F.lower(d).contains("deliver") | F.lower(d).contains("get it"))
    lined = first.withColumn("delivery_line", F.coalesce(F.get(told, 0), F.get("delivery", 0))).withColumn(
        "_link", _or(c("link_clean"), F.coalesce("link", F.lit("")))
    )
    mapped = _common(filter_here(lined, c("_link") != ""), as_of)
    return mapped.select(
        "query_id",
        F.concat(F.lit("a-"), _or(c("asin"), F.substring(F.md5("title"), 1, 10))).alias("listing_id"),
        F.lit("amazon").alias("marketplace"),
        F.lit("Amazon.in").alias("seller_name"),
        "title",
        F.lit("").alias("description"),
        "price", "mrp", "image_url", "rating", "review_count", "delivery_days", "delivery_text", "availability",
        (0.5 + F.coalesce(F.nullif("position", F.lit(0)), F.lit(50))).cast("double").alias("position"),
        F.lit("").alias("page_token"),
        F.lit("").alias("feed_link"),
        c("_link").alias("product_url"),
        F.lit(True).alias("direct"),
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0].select(*FEED_LISTING)
    for feed in feeds[1:]:
        out = out.unionByName(feed.select(*FEED_LISTING))
    return out
