"""Feed-like rows that Spark derives from the benchmark tables.

The tables hold no store names, delivery texts or feed titles, so these are
put together from their columns; every row count follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.session import spread
from pricemesh.sources.tables import offers, table

STORE_NAMES = [
    "Amazon.in", "Flipkart", "Croma", "Reliance Digital", "Apple Store", "JioMart Grocery", "Cashify",
    "ubuy.co.in", "www.tatacliq.com", "Vijay Sales", "Samsung Shop - India", "Purplle.com - Beauty Online",
]
DELIVERY_TEXTS = [
    "Free delivery tomorrow", "Delivery in 3 days", "Free delivery", "Delivery in 2-4 days", "Delivery by 2 Oct",
    "by 29 Feb", "Get it Wed", "Free 10 min delivery", "", "Arrives today", "Ships in 5 business days",
    "Delivered by March 15", "monthly plan", "by Feb 30, Sunday", "3 to 7 working days",
]
TITLE_ENDINGS = [
    " 100 ml", " 8GB RAM 128 GB", " (Size 32)", " Men's Slim Fit Cotton", " 5 W charger", " Dark Blue XL",
    " Women loose fit fleece hoodie", " 5G 256gb 1 TB, 2.5 kg", " Levis 32w x 32l jeans", " UK 9 - 3.6 g / new",
    " Transparent back cover (silicone)", " 32 Ltrs Thunder Grey",
]
BRAND_WORDS = ["Samsung", "Redmi", "Apple", "boAt", "Nothing", "Acme", "Galaxy"]
TITLE_FACTS = ["", " (128 GB, Black)", " 8GB RAM 256GB Storage", " 12GB 512GB Desert Titanium", " 500 ml", " Sky Blue"]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index % len(values))


def shelf_titles(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per part whose title carries the facts attribute rules look for."""
    p = F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), "p_brand", pick(TITLE_ENDINGS, p))
    supplied = F.when(
        p % 5 == 0,
        F.create_map(
            F.lit("Colour"), F.lit("Bold Black"), F.lit("Color"), F.lit("Crystal Clear"),
            F.lit("Quantity"), F.concat(F.col("p_size"), F.lit("ml")), F.lit("shade"), F.lit("MR1 Red Coat"),
        ),
    ).when(
        p % 5 == 1,
        F.create_map(
            F.lit("size"), F.concat(F.lit("UK "), F.col("p_size")), F.lit("storage"), F.lit("64GB total"),
            F.lit("fit"), F.lit("Loose"), F.lit("model"), F.lit("Galaxy   S25"),
        ),
    )
    return spread(table(spark, folder, "part")).select(
        p.cast("string").alias("listing_id"),
        p.alias("position"),
        title.alias("title"),
        F.lit("").alias("description"),
        F.when(p % 11 == 0, "Levis").when(p % 11 == 1, "Generic").otherwise(F.col("p_brand")).alias("brand"),
        F.when(p % 13 == 0, "Shoes").otherwise(F.col("p_type")).alias("category"),
        supplied.cast("map<string,string>").alias("product_attributes"),
    )


def feed_base(spark: SparkSession, folder: str) -> DataFrame:
    """What the feed rows are put together from: offers with their part's name and size, which name the query."""
    base = offers(spark, folder).select("product_id", "position", "rating", "review_count")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return base.join(parts, F.col("product_id") == F.col("p_partkey"))


def shopping_rows(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """Shopping results: one row per offer, with the part's name and size as the query.

    ``base``: rows of ``feed_base``, if they are written already.
    """
    joined = feed_base(spark, folder) if base is None else base
    p, s = F.col("product_id"), F.col("position") % 1000000
    title = F.concat(
        pick(BRAND_WORDS, p), F.lit(" "), "p_name", F.lit(" S"), "p_size",
        F.when(s % 4 == 0, " Pro").when(s % 4 == 1, " 5G").otherwise(""),
        pick(TITLE_FACTS, p + s),
        F.when((p + s) % 17 == 0, " - Refurbished").otherwise(""),
        F.when((p + 2 * s) % 19 == 0, " Case").otherwise(""),
        F.when(s % 10 == 0, " | free delivery").otherwise(""),
    )
    rupees = 10000 + (p % 50) * 100 + (s % 7) * 700
    cents = F.when((p + s) % 23 == 0, ".14").otherwise("")
    amount = F.concat(rupees.cast("string"), cents)
    return joined.select(
        F.concat(F.col("p_name"), F.lit(" s"), F.col("p_size")).alias("query_id"),
        p.alias("product_key"),
        ((p * 31 + s * 7) % 1000 + 1).cast("int").alias("position"),
        title.alias("title"),
        pick(STORE_NAMES, s).alias("source"),
        F.concat(F.when((p + s) % 29 == 0, "$").otherwise("₹"), amount).alias("price"),
        amount.alias("extracted_price"),
        F.when(p % 3 == 0, (rupees + 500).cast("string")).alias("extracted_old_price"),
        F.when(p % 4 != 0, F.concat(F.lit("pid"), p)).alias("product_id"),
        F.concat(F.lit("/img/"), p).alias("thumbnail"),
        F.lit(None).cast("string").alias("snippet"),
        F.col("rating").cast("string").alias("rating"),
        F.when(s % 5 == 0, "n/a").otherwise(F.col("review_count").cast("string")).alias("reviews"),
        pick(DELIVERY_TEXTS, p + s).alias("delivery"),
        F.concat(F.lit("https://shop.example/p/"), p).alias("product_link"),
        F.when(s % 3 == 0, F.concat(F.lit("tok"), s)).alias("immersive_product_page_token"),
        F.lit("").alias("page_token"),
        F.concat(F.lit("https://api.example/s?engine=x&page_token=q"), s).alias("serpapi_immersive_product_api"),
    )


def marketplace_rows(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """The marketplace's own results for the same queries."""
    rows = shopping_rows(spark, folder, base)
    k = F.col("position")
    return rows.select(
        "query_id",
        "position",
        F.when(k % 3 != 0, F.concat(F.lit("B0"), F.col("product_key"), F.lit("X"), k)).alias("asin"),
        "title",
        F.when(k % 7 != 0, F.concat(F.lit("https://m.example/d/"), k)).alias("link"),
        F.when(k % 2 == 0, F.concat(F.lit("https://m.example/c/"), k)).alias("link_clean"),
        "extracted_price",
        "extracted_old_price",
        "rating",
        "reviews",
        "thumbnail",
        F.array(F.lit("In stock"), F.col("delivery"), F.lit("Or get it Today")).alias("delivery"),
        (k % 11 == 0).alias("sponsored"),
    )


def store_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Further stores' offers for the products of ``offers``."""
    base = offers(spark, folder).select("product_id", "position", "price", "title")
    p, s = F.col("product_id"), F.col("position") % 1000000
    return base.select(
        "product_id",
        s.cast("int").alias("offer_order"),
        pick(STORE_NAMES, p + s).alias("name"),
        F.when(s % 3 == 0, "").otherwise(F.concat(F.col("title"), pick(TITLE_FACTS, s))).alias("title"),
        F.when(s % 9 != 0, F.concat(F.lit("https://"), F.lit("store"), s % 12, F.lit(".example/p/"), p)).alias("link"),
        F.when(s % 8 == 0, F.concat(F.floor("price").cast("string"), F.lit(".5")))
        .otherwise(F.floor("price").cast("string"))
        .alias("extracted_price"),
        F.when(s % 2 == 0, (F.floor("price") + 900).cast("string")).alias("extracted_original_price"),
        F.lit("4.1").alias("rating"),
        F.when(s % 4 == 0, "12").alias("reviews"),
        F.array(F.lit("In stock"), pick(DELIVERY_TEXTS, p + 2 * s)).alias("details_and_offers"),
        F.lit("Ships in 6 days").alias("shipping"),
    )
