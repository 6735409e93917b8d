"""The registered queries: every operator over the whole tables of a folder.

Arrays and maps are written out as text, so results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions import delivery, display, identity, images, stores, text
from pricemesh.functions.attributes import public_attributes, with_attributes
from pricemesh.operators import (
    embedding, enrich, explain, idf, ingest, offers, products, ranking, rulegroup, scoring, search, sorting, substring, suggest,
)
from pricemesh.operators.filters import Filters
from pricemesh.plans import catalog as batch
from pricemesh.plans import detail, requests
from pricemesh.plans.search import result_pages, search_groups
from pricemesh.session import cut_lineage, release, scratch_folder, shared_folder, written
from pricemesh.sources import adapters, derived, feeds, sinks, tables
from pricemesh.streaming import history as stream_history_job
from pricemesh.streaming import upsert as stream_upsert_job

Query = Callable[[SparkSession, str], DataFrame]


def _as_of() -> Column:
    return F.lit("2026-09-28").cast("date")


def _said(column: str) -> Column:
    return F.array_join(F.transform(column, lambda r: F.concat(r["label"], F.lit(":"), r["status"])), ";")


def _written(attributes: Column) -> Column:
    entries = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _listings(spark: SparkSession, folder: str) -> DataFrame:
    return offers.with_discount(tables.offers(spark, folder))


# --- offers ---------------------------------------------------------------------

_ROLLUP = [
    "cheapest_listing", "cheapest_price", "cheapest_store", "fastest_listing", "fastest_days", "fastest_store",
    "price_min", "price_max", "rating_min", "rating_max", "discount_max", "slowest_days", "store_count",
    "listing_count",
]


def _rollup_columns(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *_ROLLUP, F.array_join("marketplaces", ",").alias("marketplaces"))


def offer_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup_columns(offers.rollup(_listings(spark, folder), ["product_id"]), "product_id")


def offers_filtered(spark: SparkSession, folder: str) -> DataFrame:
    wanted = Filters(
        price_min=2000.0, price_max=60000.0, max_delivery_days=5, min_rating=2.0, in_stock_only=True,
        marketplaces=tuple(f"nation_{i}" for i in range(15)), brands=tuple(f"BRAND#{i}" for i in range(1, 21)),
    )
    kept = _listings(spark, folder).filter(wanted.condition())
    return _rollup_columns(offers.rollup(kept, ["product_id"]), "product_id")


def offers_sorted(sort: str, spark: SparkSession, folder: str) -> DataFrame:
    rows = _listings(spark, folder).withColumn("relevance", F.lit(0.0)).select(
        "product_id", "listing_id", "position", "price", "delivery_days", "availability", "rating", "review_count",
        "discount_percentage", "relevance",
    )
    ranked = sorting.sort_listings(rows, ["product_id"], sorting.check_sort(sort))
    return ranked.select("product_id", "listing_id", F.col("rank").cast("bigint").alias("rank"))


def group_sort(sort: str, spark: SparkSession, folder: str) -> DataFrame:
    groups = offers.rollup(_listings(spark, folder), ["product_id"]).withColumn("relevance", F.col("rating_max") / 10)
    # The ranking writes its rows out, so they carry the keys of the sort alone.
    ranked = sorting.sort_groups(groups.select("product_id", *sorting.group_columns(sort)), [], sorting.check_sort(sort))
    return ranked.select("product_id", F.col("rank").cast("bigint").alias("rank"))


def discounts(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder).select("listing_id", "discount_percentage")


def delivery_info(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    available = c("availability") != "out_of_stock"
    return tables.offers(spark, folder).select(
        "listing_id",
        delivery.delivery_date(c("delivery_days"), _as_of()).cast("string").alias("delivery_date"),
        delivery.delivery_text(c("delivery_days"), available, _as_of()).alias("delivery_text"),
    )


def compare_chosen(spark: SparkSession, folder: str) -> DataFrame:
    listings = _listings(spark, folder)
    chosen = listings.select(F.col("seller_name").alias("request_id"), "listing_id")
    return _rollup_columns(offers.compare_chosen(chosen, listings, "delivery_fastest"), "request_id")


def delivery_estimates(spark: SparkSession, folder: str) -> DataFrame:
    listings = tables.offers(spark, folder)
    p, s = F.col("product_id"), F.col("position") % 1000000
    asked = listings.select(
        F.when(s % 7 == 0, "nowhere").otherwise(F.col("marketplace")).alias("marketplace"),
        F.when(s % 2 == 0, F.col("listing_id")).otherwise(F.concat_ws("-", p, s + 1)).alias("listing_id"),
    )
    places = tables.table(spark, folder, "nation").select(F.lower("n_name").alias("slug"))
    return offers.delivery_estimates(asked, listings, places)


def facets(spark: SparkSession, folder: str) -> DataFrame:
    found = offers.facets(tables.offers(spark, folder), ["category"])
    return found.select("category", F.array_join("stores", ",").alias("stores"), F.array_join("brands", ",").alias("brands"), "n_stores")


def _stores(spark: SparkSession, folder: str) -> DataFrame:
    """Part numbers and offers as eight stores with columns of their own."""
    shelf = lambda k: lambda s: tables.catalog(s, folder).filter(F.col("position") % 7 == k).drop("seller_name", "currency")
    market = lambda s: tables.offers(s, folder).withColumnRenamed("product_id", "part").withColumn("rating", F.col("rating").cast("string"))
    stores = [adapters.StoreAdapter(f"shelf-{k}", shelf(k)) for k in range(7)]
    return adapters.union_stores(spark, [*stores, adapters.StoreAdapter("market", market)])


def store_union(spark: SparkSession, folder: str) -> DataFrame:
    return _stores(spark, folder).select("marketplace", "listing_id", "seller_name", "title", "price", "rating", "currency")


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of an order asks for its part at one of nine stores, of which one does not exist."""
    k = F.col("l_orderkey") % 9
    part = F.col("l_partkey").cast("string")
    asked = tables.table(spark, folder, "lineitem").select(
        F.when(k < 8, F.concat(F.lit("shelf-"), k)).otherwise("market").alias("marketplace"),
        F.when(k < 8, part).otherwise(F.concat_ws("-", part, F.col("l_suppkey"))).alias("listing_id"),
    )
    return adapters.point_lookup(asked, _stores(spark, folder)).select("marketplace", "listing_id", "title", "price")


def keyword_scan(spark: SparkSession, folder: str) -> DataFrame:
    return tables.keyword_scan(tables.offers(spark, folder), "Ring 7").select("listing_id", "title")


def presentation(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    rows = with_attributes(derived.shelf_titles(spark, folder)).join(
        offers.rollup(_listings(spark, folder), ["product_id"]), c("position") == c("product_id")
    )
    reviews = c("listing_count") * 317
    return rows.select(
        "listing_id",
        display.subtitle(public_attributes(c("attributes"))).alias("subtitle"),
        display.compact_number(reviews).alias("reviews_shown"),
        display.saving(c("price_min"), c("price_max")).alias("saving"),
        text.clean_title(c("title")).alias("clean_title"),
    )


# --- text -------------------------------------------------------------------------


def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_attributes(derived.shelf_titles(spark, folder))
    return rows.select(
        "listing_id",
        text.normalize_title(F.col("title")).alias("normalized_title"),
        F.array_join(text.tokens(F.col("title")), " ").alias("tokens"),
        text.search_text(F.col("title"), F.col("attributes")).alias("search_text"),
    )


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    toks = tables.table(spark, folder, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return toks.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


def attributes_inferred(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_attributes(derived.shelf_titles(spark, folder))
    return rows.select("listing_id", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in vocab.ATTRIBUTE_WEIGHTS])


def corpus_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(text.tokens(F.col("text")).alias("t"))
    return idf.corpus_idf(docs, "t").select("token", "df", (F.col("idf_micros") / 1000000).alias("idf"))


def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.catalog(spark, folder).select(F.col("listing_id").alias("id"), F.col("title").alias("text"))
    return embedding.hashed_embedding(docs).select(
        F.col("id").alias("listing_id"), F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight")
    )


def dense_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against the next one."""
    vectors = tables.table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(embedding.dense_cosine(F.col("embedding"), F.col("next")), 6).alias("cosine")
    )


def hash_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Image hash of each part against that of the next one."""
    rows = tables.catalog(spark, folder).select("position", "image_hash")
    following = rows.select((F.col("position") - 1).alias("position"), F.col("image_hash").alias("next"))
    return rows.join(following, "position").select(
        "position", images.hash_similarity(F.col("image_hash"), F.col("next")).alias("similarity")
    )


# --- search -------------------------------------------------------------------------


def search_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text as a query over every document."""
    docs = tables.table(spark, folder, "documents").select(
        "doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("search_text")
    )
    queries = tables.table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )
    hits = search.coverage(queries, search.distinct_texts(docs))
    keyed = docs.select("doc_id", text.digest(F.col("search_text")).alias("text_id"))
    return hits.join(keyed, "text_id").select("query_id", "doc_id", F.round("coverage", 6).alias("coverage"))


def _search_listings(spark: SparkSession, folder: str) -> DataFrame:
    found = search.with_search_text(_listings(spark, folder)).select(
        "listing_id", "product_id", "position", "marketplace", "brand", "price", "rating", "review_count", "delivery_days",
        "availability", "discount_percentage", "search_text",
    )
    return cut_lineage(found)   # stands for the written listing table, with what a search reads


def _query_table(spark: SparkSession, folder: str) -> DataFrame:
    """One query per part name and brand of large sizes, each with its own filters."""
    parts = tables.table(spark, folder, "part")
    asked = parts.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("query")).agg(F.max("p_size").alias("p_size"))
    return asked.select(
        F.col("query").alias("query_id"),
        "query",
        F.lit(None).cast("string").alias("pincode"),
        F.lit("relevance").alias("sort"),
        F.lit(None).cast("array<string>").alias("marketplaces"),
        F.lit(None).cast("double").alias("price_min"),
        F.when(F.col("p_size") % 2 == 0, 50000.0).alias("price_max"),
        F.when(F.col("p_size") % 3 == 0, 4).alias("max_delivery_days"),
        F.lit(1.5).alias("min_rating"),
        F.lit(None).cast("array<string>").alias("brands"),
        (F.col("p_size") % 5 == 0).alias("in_stock_only"),
    )


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    groups = search_groups(_query_table(spark, folder), _search_listings(spark, folder))
    return _rollup_columns(groups, "query_id", "product_id", "relevance")


def search_totals(spark: SparkSession, folder: str) -> DataFrame:
    groups = search_groups(_query_table(spark, folder), _search_listings(spark, folder))
    return offers.totals(groups, ["query_id"])


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One query per part name and type over the matched catalog, each with one of the eight sorts and its own filters."""
    built = batch.build(tables.catalog(spark, folder))
    listings = cut_lineage(
        offers.with_discount(built.membership()).withColumn("search_text", text.search_text(F.col("title"), F.col("attributes")))
    )
    size = F.col("z")
    sorts = F.array(*[F.lit(s) for s in vocab.SORT_KEYS])
    parts = tables.table(spark, folder, "part")
    asked = parts.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("query")).agg(F.max("p_size").alias("z"))
    queries = asked.select(
        F.col("query").alias("query_id"), "query",
        F.element_at(sorts, (size % len(vocab.SORT_KEYS) + 1).cast("int")).alias("sort"),
        F.lit(None).cast("array<string>").alias("marketplaces"),
        F.lit(None).cast("double").alias("price_min"),
        F.lit(None).cast("double").alias("price_max"),
        F.when(size % 3 == 0, 5).alias("max_delivery_days"),
        F.when(size % 2 == 0, 1.5).alias("min_rating"),
        F.lit(None).cast("array<string>").alias("brands"),
        F.lit(False).alias("in_stock_only"),
    )
    return result_pages(queries, listings, built).select(
        "query_id", "sort", F.col("place").cast("bigint").alias("place"), "product_id", "relevance", "cheapest_listing",
        "fastest_listing", "listing_count", "store_count", F.array_join("marketplaces", ",").alias("marketplaces"),
        "confidence", "pair_count", "text", "attribute", "image", _said("reasons").alias("reasons"),
    )


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    searched = events.select(
        F.concat(
            F.when(F.col("user_id") % 3 == 0, F.initcap("event_type")).otherwise(F.col("event_type")),
            F.lit(" "), F.col("user_id") % 4,
        ).alias("query"),
        F.col("ts").alias("created_at"),
    )
    names = tables.catalog(spark, folder).select(F.col("title").alias("canonical_title"), F.col("position").alias("group_position"))
    past = suggest.history_suggestions(searched, "I")
    merged = suggest.merged_suggestions(past, suggest.product_suggestions(names, "Gear Brand#1"))
    return merged.select("text", F.col("place").cast("bigint").alias("place"))


# --- scored matching -----------------------------------------------------------------


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    _, _, pairs = batch.match_pairs(tables.catalog(spark, folder))
    return pairs.select(
        "profile_a", "profile_b", "n_pairs", "text_score", "attribute_score", "image_score", "combined_score", "match_type"
    )


def pair_reasons(spark: SparkSession, folder: str) -> DataFrame:
    _, _, pairs = batch.match_pairs(tables.catalog(spark, folder))
    return pairs.withColumn("r", scoring.reasons()).select("profile_a", "profile_b", _said("r").alias("reasons"))


def requested_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each profile against the next one, whatever comes out."""
    _, weighted, _ = batch.match_pairs(tables.catalog(spark, folder))
    ids = weighted.select("profile_id")
    asked = ids.select(F.col("profile_id").alias("profile_a"), (F.col("profile_id") + 1).alias("profile_b")).join(
        ids.select(F.col("profile_id").alias("profile_b")), "profile_b", "left_semi"
    )
    scored = scoring.score_requested(asked, weighted, batch.MatchConfig())
    return scored.select("profile_a", "profile_b", "text_score", "attribute_score", "image_score", "combined_score", "match_type")


def title_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Titles holding each of many needles, found by an index in two parts: one and two letters, words, pieces of words, none."""
    part = tables.table(spark, folder, "part")
    shelf = tables.catalog(spark, folder)
    work = shared_folder(spark).rstrip("/") + f"/titles-{uuid.uuid4().hex}"
    for number, rows in enumerate((shelf.filter("position % 3 <> 0"), shelf.filter("position % 3 = 0"))):
        substring.write_index(rows, "position", "title", work, number)
    needles = part.select(
        F.explode(F.expr("array(substr(p_name, 2, 1), substr(p_name, 3, 2), substr(p_name, 2, 4), concat('  ', upper(p_brand)), concat('size ', p_size), concat('zq', p_size))")).alias("needle")
    )
    found = substring.find_substrings(needles, "needle", shelf, "position", "title", work)
    return found.groupBy("needle").agg(
        F.count("*").alias("titles"), F.min("id").alias("first_position"), F.sum("id").alias("positions")
    )


def match_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each listing against the next, every third against a row sent along whose title holds words no listing has."""
    shelf = tables.catalog(spark, folder)
    p = F.col("position")
    third = p % 3 == 0
    asked = shelf.select(
        F.col("listing_id").alias("request_id"), F.col("listing_id").alias("listing_a"),
        F.when(~third, (p + 1).cast("string")).alias("listing_b"),
    )
    part = tables.table(spark, folder, "part").withColumn("position", F.col("p_partkey")).filter(third)
    spare = part.select("position", F.concat("p_name", F.lit(" spare x"), "p_partkey", F.lit(" size "), "p_size").alias("spare"))
    sent = shelf.join(spare, "position").select(
        F.col("listing_id").alias("request_id"), F.lit("b").alias("side"), F.col("spare").alias("title"), *requests.PAYLOAD[1:]
    )
    work = shared_folder(spark).rstrip("/") + f"/match-requests-{uuid.uuid4().hex}"
    sinks.write_statistics(requests.catalog_statistics(shelf), work, 1)
    found = requests.match_requests(asked, sent, shelf, sinks.read_statistics(spark, work))
    return found.select(
        "request_id", "listing_a", "listing_b", "outcome", "text_score", "attribute_score", "image_score", "combined_score", "match_type",
        F.when(F.col("reasons").isNotNull(), _said("reasons")).alias("reasons"),
    )


def product_components(spark: SparkSession, folder: str) -> DataFrame:
    built = batch.build(tables.catalog(spark, folder))
    return built.membership().select("listing_id", "product_id")


def canonical_products(spark: SparkSession, folder: str) -> DataFrame:
    rows = batch.build(tables.catalog(spark, folder)).products()
    return rows.select(
        "product_id", "canonical_title", "brand", "category", "description", "canonical_image",
        _written(F.col("attributes")).alias("attributes"), "listing_count",
    )


def explanations(spark: SparkSession, folder: str) -> DataFrame:
    rows = batch.build(tables.catalog(spark, folder)).explanations()
    return rows.select(
        F.col("class_id").alias("product_id"), "pair_count", "confidence", "text", "attribute", "image", _said("reasons").alias("reasons")
    )


def similar_products(spark: SparkSession, folder: str) -> DataFrame:
    rows = batch.build(tables.catalog(spark, folder)).similar()
    return rows.select(
        F.col("class_id").alias("product_id"), F.col("other_class").alias("other_product"), "similarity",
        _said("reasons").alias("reasons"),
        F.array_join(F.transform(explain.telling_reasons(F.col("reasons")), lambda r: r["label"]), ";").alias("telling"),
    )


def _partly_hashed(spark: SparkSession, folder: str) -> batch.Build:
    """The catalog with image hashes for odd sizes only, so some copies stay apart, and few images."""
    rows = tables.catalog(spark, folder)
    size = F.col("product_attributes")["size"].cast("int")
    return batch.build(
        rows.withColumn("image_hash", F.when(size % 2 == 1, F.col("image_hash")))
        .withColumn("image_url", F.concat(F.lit("/img/"), F.col("position") % 3))
    )


def product_detail(spark: SparkSession, folder: str) -> DataFrame:
    return detail.product_details(_partly_hashed(spark, folder)).select(
        "product_id", "cheapest_listing", "fastest_listing", "listing_count", "store_count", "n_similar", "all_listings",
        "confidence", "pair_count", _said("reasons").alias("reasons"),
    )


def product_images(spark: SparkSession, folder: str) -> DataFrame:
    rows = detail.product_images(_partly_hashed(spark, folder))
    return rows.select("product_id", "image_url", F.col("image_rank").cast("bigint").alias("image_rank"))


def product_similar(spark: SparkSession, folder: str) -> DataFrame:
    rows = detail.product_similar(_partly_hashed(spark, folder))
    return rows.select(
        "product_id", "other_product", F.col("place").cast("bigint").alias("place"), "similarity", "listing_count",
        _said("reasons").alias("reasons"),
    )


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    built = batch.build(tables.catalog(spark, folder))
    return products.batch_summary(built.members, built.products(), built.pairs)


# --- stores, delivery, places -----------------------------------------------------------


def store_resolution(spark: SparkSession, folder: str) -> DataFrame:
    sellers = tables.table(spark, folder, "supplier")
    s = F.col("s_suppkey")
    named = sellers.select("s_suppkey", F.concat(derived.pick(derived.STORE_NAMES, s), F.when(s % 4 == 3, " India").otherwise("")).alias("source"))
    return stores.with_store(named, "source").select("s_suppkey", "source", "listed_slug", "store_slug", "store_name", "store_colour")


def delivery_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Delivery texts of all orders; the order's own date is written into some of them."""
    k = F.col("o_orderkey")
    told = tables.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, F.concat(F.lit("Delivery by "), F.date_format("o_orderdate", "d MMM")))
        .when(k % 3 == 1, F.concat(F.lit("Arrives "), F.date_format("o_orderdate", "EEEE, MMMM d")))
        .otherwise(derived.pick(derived.DELIVERY_TEXTS, k))
        .alias("line"),
    )
    return delivery.with_delivery_days(told, "line", _as_of()).select("o_orderkey", "line", "delivery_days")


def locations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    city = derived.pick(["Bangalore", "Gurgaon", "Pune", "Bombay", "Trivandrum"], k)
    pincode = F.concat(F.lit("PIN "), F.substring((100000 + k * 37).cast("string"), 1, 3), F.lit(" "), F.when(k % 4 == 0, "12").otherwise("123"))
    return tables.table(spark, folder, "customer").select(
        "c_custkey", display.location_pincode(pincode).alias("pincode"), display.canonical_city(city).alias("city")
    )


def store_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = feeds.shopping_listings(derived.shopping_rows(spark, folder), _as_of())
    c = F.col
    direct = F.when(c("position") % 2 == 0, F.concat(F.lit("/api/go/"), c("listing_id"))).otherwise("")
    feed = F.when(c("position") % 3 == 0, c("feed_link")).otherwise("")
    return rows.select(
        "query_id", "listing_id", stores.best_link(direct, feed, c("marketplace"), c("title")).alias("link")
    ).distinct()


# --- feeds and rule matching -----------------------------------------------------------------


def _feed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "listing_id", "marketplace", "seller_name", "title", "price", "mrp", "rating", "review_count",
        "delivery_days", "delivery_text", "position", "page_token", "product_url",
    )


def feed_shopping(spark: SparkSession, folder: str) -> DataFrame:
    return _feed_columns(feeds.shopping_listings(derived.shopping_rows(spark, folder), _as_of()))


def feed_marketplace(spark: SparkSession, folder: str) -> DataFrame:
    return _feed_columns(feeds.marketplace_listings(derived.marketplace_rows(spark, folder), _as_of()))


def title_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived.shopping_rows(spark, folder).select("title", F.col("query_id").alias("query")).distinct()
    found = identity.with_identity(rows, "title")
    i = lambda k: F.col(f"identity.{k}")
    return found.select(
        "title", "query", i("brand").alias("brand"), F.array_join(i("model"), " ").alias("model"),
        F.array_join(i("family"), " ").alias("family"), i("storage").alias("storage"), i("ram").alias("ram"),
        i("colour").alias("colour"), i("condition").alias("condition"), i("quantity").alias("quantity"),
        i("brand_guess").alias("brand_guess"),
        identity.is_accessory(F.col("identity"), identity.query_words(F.col("query"))).alias("accessory"),
    )


#: Offers whose feed rows are grouped at a time.  A slice holds whole queries, so its groups are those of the whole.
SLICE_ROWS = 2_000_000


def _rule_offers(spark: SparkSession, folder: str, told: tuple[str, ...] = (), found: tuple[str, ...] = ()) -> DataFrame:
    """Grouped offers, one per store and group, with the columns ``told`` by the feeds and ``found`` by the text rules.

    Slices of the queries go one after another: what lies on disk between the steps is that of one slice.
    Of equal listings the one whose columns come first is kept, so ``told`` begins with the columns before those asked for.
    """
    read = ["query_id", "listing_id", "marketplace", "title", "price", "position", *told]
    grouping = ["query_id", "listing_id", "marketplace", "price", "position", "specificity", "block", "facts"]
    base = derived.feed_base(spark, folder)
    slices = max(1, -(-tables.table(spark, folder, "lineitem").count() // SLICE_ROWS))
    done = f"{shared_folder(spark).rstrip('/')}/rule-offers-{uuid.uuid4().hex}"
    with scratch_folder(spark, "rule-feeds") as feed:
        slice_of = F.pmod(F.xxhash64("p_name", "p_size"), F.lit(slices)).cast("int")
        sliced = base.withColumn("_slice", slice_of)
        sliced.select("*").write.partitionBy("_slice").parquet(f"{feed}/base")
        kept = spark.read.schema(sliced.schema).parquet(f"{feed}/base")
        release(spark)
        for k in range(slices):
            with scratch_folder(spark, "rule-slice") as here:
                keep = partial(written, folder=here)
                rows = kept.filter(F.col("_slice") == k).drop("_slice")
                raws = feeds.union_feeds(
                    feeds.shopping_listings(derived.shopping_rows(spark, folder, rows), _as_of()),
                    feeds.marketplace_listings(derived.marketplace_rows(spark, folder, rows), _as_of()),
                ).select(*read).withColumn("query", F.col("query_id"))
                rows = rulegroup.identified(raws, keep).select(*grouping, *told, *found)
                grouped = rulegroup.assign_groups(rows, keep=keep)
                offered = rulegroup.one_offer_per_store(grouped)
                offered.select("*").write.mode("append").parquet(done)
                schema = offered.schema
    return spark.read.schema(schema).parquet(done)


def rule_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_offers(spark, folder).select("query_id", "group_id", "listing_id", "marketplace", "price")


def rule_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rule_offers(spark, folder, found=("identity", "accessory"))
    return rulegroup.group_pairs(rows).withColumn("reasons", _said("reasons"))


def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    told = ("seller_name", "description", "mrp", "image_url", "rating", "review_count", "delivery_days", "direct")
    rows = _rule_offers(spark, folder, told, ("query", "title", "identity"))
    scored = ranking.score_groups(rulegroup.rule_groups(rows))
    shown = ranking.final_groups(ranking.visible_groups(scored))
    return shown.select(
        "query_id", "place", "canonical_title", "relevance", "price_min", "price_max", "listing_count", "fastest_days",
        F.array_join("marketplaces", ",").alias("marketplaces"), _written(F.col("attributes")).alias("attributes"),
    )


def rule_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance and flags with every shopping title of a query as a group of its own."""
    rows = feeds.shopping_listings(derived.shopping_rows(spark, folder), _as_of())
    groups = rows.groupBy("query_id", F.col("title").alias("canonical_title")).agg(
        F.min(F.when(F.col("position") % 9 == 0, F.col("price") / 4).otherwise(F.col("price"))).alias("price_min"),
        F.array_sort(F.collect_set("marketplace")).alias("marketplaces"),
    )
    scored = ranking.score_groups(groups.withColumn("query", F.col("query_id")))
    return scored.select("query_id", "canonical_title", "price_min", "relevance", F.array_join("flags", ",").alias("flags"))


# --- ingest and enrichment ----------------------------------------------------------------------


def _known_and_fresh(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    listings = _listings(spark, folder).select(
        "listing_id", "position", "product_id", "seller_name", "title", "price", "mrp", "discount_percentage"
    )
    return listings, _fresh(listings)


def _fresh(listings: DataFrame) -> DataFrame:
    """Feed rows for some of the listings and as many new ones."""
    p, s = F.col("product_id"), F.col("position") % 1000000
    return listings.select(
        F.when((p + s) % 3 == 0, F.col("listing_id")).otherwise(F.concat(F.lit("n-"), s, F.lit("-"), p % 100)).alias("listing_id"),
        "position", F.lit(None).cast("bigint").alias("product_id"), "seller_name", "title",
        F.floor(F.col("price") * 0.9).cast("double").alias("price"), F.floor("mrp").cast("double").alias("mrp"),
    )


def upsert(spark: SparkSession, folder: str) -> DataFrame:
    listings, fresh = _known_and_fresh(spark, folder)
    return ingest.upsert(listings, fresh).select("listing_id", "product_id", "price", "mrp", "discount_percentage")


def new_stores(spark: SparkSession, folder: str) -> DataFrame:
    told = derived.store_offers(spark, folder).select(F.col("name").alias("seller_name"), F.col("link").alias("product_url"))
    known = spark.createDataFrame([("amazon",), ("croma",)], "slug string")
    return ingest.new_stores(told, known)


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    hits = events.select(
        F.concat(F.lit(" "), F.upper("event_type"), F.lit("  shoes ")).alias("query"),
        F.concat(F.lit("city"), F.col("user_id")).alias("location"),
        (F.col("event_id") % 97).alias("product_id"),
        F.col("value").alias("position"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"),
    )
    ranked = hits.groupBy(text.query_key(F.col("query"), F.col("location")).alias("query_key"), "day", "product_id").agg(F.min("position").alias("rank"))
    return ranked.groupBy("query_key", F.col("day").alias("fetched_at")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]).alias("product_ids")
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-01-30 04:00:00").cast("timestamp")
    rows = ingest.current_snapshots(_snapshots(spark, folder), now)
    return rows.select(
        "query_key", F.array_join("product_ids", ",").alias("product_ids"), F.col("fetched_at").cast("string").alias("fetched_at"), "fresh"
    )


def snapshot_products(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-01-30 04:00:00").cast("timestamp")
    parts = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), "p_name")
    rows = ingest.snapshot_products(ingest.current_snapshots(_snapshots(spark, folder), now), parts)
    return rows.select("query_key", F.col("place").cast("bigint").alias("place"), "product_id", "p_name")


def snapshot_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a request against the snapshots of its own time; the feed fails for one in five."""
    asked = tables.table(spark, folder, "events").select(
        "event_id",
        text.query_key(
            F.concat(F.lit(" "), F.upper("event_type"), F.lit("  shoes ")), F.concat(F.lit("city"), F.col("user_id"))
        ).alias("query_key"),
        F.col("ts").cast("timestamp").alias("asked_at"),
        (F.col("event_id") % 5 == 0).alias("failed"),
    )
    # A snapshot is taken at noon, so a request may find that of its own day or of a day long before.
    taken = _snapshots(spark, folder).withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 12 hours"))
    return ingest.served_snapshots(asked, taken).select(
        "event_id", "query_key", "outcome", F.array_join("product_ids", ",").alias("product_ids"),
        F.col("fetched_at").cast("string").alias("fetched_at"),
    )


def _enrich_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p, s = F.col("product_id"), F.col("position") % 1000000
    listings = _listings(spark, folder).withColumn("seller_name", F.when(s % 2 == 0, derived.pick(derived.STORE_NAMES, s)).otherwise(F.col("seller_name")))
    return listings, enrich.judged(derived.store_offers(spark, folder), listings)


def enrich_links(spark: SparkSession, folder: str) -> DataFrame:
    listings, judged = _enrich_inputs(spark, folder)
    changed = enrich.apply_links(listings, enrich.linked(judged, listings))
    return changed.filter("product_url <> ''").select("listing_id", "price", "mrp", "product_url")


def enrich_added(spark: SparkSession, folder: str) -> DataFrame:
    listings, judged = _enrich_inputs(spark, folder)
    return enrich.added(judged, listings, _as_of()).select(
        "listing_id", "product_id", "marketplace", "seller_name", "title", "price", "mrp", "delivery_days", "delivery_text", "product_url"
    )


def enrich_notes(spark: SparkSession, folder: str) -> DataFrame:
    listings, judged = _enrich_inputs(spark, folder)
    return enrich.notes(judged, listings)


# --- streaming --------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert, fed as a stream of files."""
    work = _scratch(spark)
    listings, _ = _known_and_fresh(spark, folder)
    with scratch_folder(spark, "listings") as here:
        stream_upsert_job.write_initial(written(listings, here), f"{work}/table", 8)
    # The feed is told of the listings as written: they are put together once.
    fresh = _fresh(stream_upsert_job.read_current(spark, f"{work}/table"))
    fresh.write.option("compression", "zstd").parquet(f"{work}/feed")
    feed = spark.readStream.schema(fresh.schema).parquet(f"{work}/feed")
    stream_upsert_job.start_upsert(feed, f"{work}/table", f"{work}/checkpoint", 8).awaitTermination()
    rows = stream_upsert_job.read_current(spark, f"{work}/table")
    return rows.select("listing_id", "product_id", "price", "mrp", "discount_percentage")


def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    """Searches read as a stream, repeats dropped, appended to the history."""
    work = _scratch(spark)
    events = spark.readStream.schema(tables.table(spark, folder, "events").schema).parquet(f"{folder}/events.parquet*")
    searches = events.select(
        F.concat(F.lit(" "), F.col("event_type")).alias("query"),
        F.col("user_id").cast("string").alias("pincode"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    stream_history_job.start_history(searches, work, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/history").select("query", "pincode", F.col("slot").cast("string").alias("slot"))


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {
        f.__name__: f
        for f in (
            offer_rollup, offers_filtered, discounts, delivery_info, compare_chosen, delivery_estimates, facets,
            keyword_scan, store_union, point_lookup, presentation, title_tokens, document_tokens, attributes_inferred, corpus_idf, hash_embedding,
            dense_cosine, hash_similarity, search_coverage, search_results, search_totals, search_pages, suggestions, pair_scores,
            pair_reasons, requested_pairs, match_requests, title_contains, product_components, canonical_products, explanations, similar_products,
            batch_summary, product_detail, product_images, product_similar, store_resolution, delivery_parse, locations, store_links, feed_shopping, feed_marketplace,
            title_identity, rule_groups, rule_pairs, rule_results, rule_relevance, upsert, new_stores, snapshots,
            snapshot_products, snapshot_asof, enrich_links, enrich_added, enrich_notes, stream_upsert, stream_history,
        )
    }
    for sort in vocab.SORT_KEYS:
        out[f"offers_sorted_{sort}"] = partial(offers_sorted, sort)
        out[f"group_sort_{sort}"] = partial(group_sort, sort)
    return out
