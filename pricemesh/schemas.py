"""Declared schemas of the inputs, as DDL for ``spark.read.schema``."""

from __future__ import annotations

LISTING = (
    """listing_id string, position bigint, marketplace string, seller_name string, title string,
    description string, brand string, category string, price double, mrp double, currency string,
    image_url string, image_hash string, rating double, review_count bigint, delivery_days int,
    availability string, product_attributes map<string,string>, product_url string"""
)
SHOPPING_ROW = (
    """query_id string, position int, title string, source string, price string,
    extracted_price string, extracted_old_price string, product_id string, thumbnail string,
    snippet string, rating string, reviews string, delivery string, product_link string,
    immersive_product_page_token string, page_token string, serpapi_immersive_product_api string"""
)
MARKETPLACE_ROW = (
    """query_id string, position int, asin string, title string, link string, link_clean string,
    extracted_price string, extracted_old_price string, rating string, reviews string,
    thumbnail string, delivery array<string>, sponsored boolean"""
)
STORE_OFFER = (
    """product_id bigint, offer_order int, name string, title string, link string,
    extracted_price string, extracted_original_price string, rating string, reviews string,
    details_and_offers array<string>, shipping string"""
)
SNAPSHOT = "query_key string, product_ids array<bigint>, fetched_at timestamp"
HISTORY = "query string, pincode string, created_at timestamp"
MARKETPLACE = (
    "slug string, name string, logo_url string, base_url string, brand_color string"
)
QUERY = (
    """query_id string, query string, pincode string, sort string, marketplaces array<string>,
    price_min double, price_max double, max_delivery_days int, min_rating double,
    brands array<string>, in_stock_only boolean"""
)
