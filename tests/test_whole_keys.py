"""Ids, slugs, titles and query keys stay whole, however long; feeds and pages are only limited on request."""

from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.functions.stores import with_store
from pricemesh.functions.text import clean_rule_title, query_key
from pricemesh.operators import ranking
from pricemesh.schemas import MARKETPLACE_ROW, SHOPPING_ROW
from pricemesh.sources import feeds

LONG = "x" * 300


def _as_of():
    return F.lit("2026-09-28").cast("date")


def test_long_product_ids_keep_listings_apart(spark):
    base = dict(query_id="q", position=1, source="Croma", price="₹900", extracted_price="900", delivery="", product_id=LONG)
    rows = spark.createDataFrame([{**base, "title": "Kettle"}, {**base, "title": "Toaster"}], SHOPPING_ROW)
    ids = {r.listing_id for r in feeds.shopping_listings(rows, _as_of()).collect()}
    assert len(ids) == 2 and all(LONG in i for i in ids)


def test_long_stores_and_queries_keep_their_ends(spark):
    df = spark.createDataFrame([(LONG + "a", "pune"), (LONG + "b", "pune"), (LONG + "b", "agra")], "name string, place string")
    stores = with_store(df, "name").collect()
    assert {r.store_slug for r in stores} == {LONG + "a", LONG + "b"} == {r.store_name for r in stores}
    keys = {r[0] for r in df.select(query_key(F.col("name"), F.col("place"))).collect()}
    assert keys == {f"{LONG}a|pune", f"{LONG}b|pune", f"{LONG}b|agra"}
    assert {r[0] for r in df.select(clean_rule_title(F.col("name"))).collect()} == {LONG + "a", LONG + "b"}


def test_feed_and_page_limits_are_optional(spark):
    own = spark.createDataFrame(
        [dict(query_id="q", position=k, asin=f"B{k}", title=f"Kettle {k}", link="https://m.example/k", extracted_price="900") for k in range(1, 31)],
        MARKETPLACE_ROW,
    )
    assert feeds.marketplace_listings(own, _as_of()).count() == 30
    assert feeds.marketplace_listings(own, _as_of(), RuleConfig(second_feed_rows=20)).count() == 20
    groups = spark.createDataFrame(
        [("q", f"g{i:02}", f"Kettle {i}", 1.0, ["a"], float(i)) for i in range(30)],
        "query_id string, group_id string, canonical_title string, relevance double, marketplaces array<string>, rank double",
    )
    every = ranking.final_groups(groups).orderBy("place").collect()
    assert [r.place for r in every] == list(range(1, 31)) and every[0].group_id == "g00"
    page = ranking.final_groups(groups, RuleConfig(max_groups=12)).orderBy("place").collect()
    assert [r.group_id for r in page] == [r.group_id for r in every[:12]]
