"""Registered queries against their SQL on the smallest tables, and the sorts and filters."""

import duckdb
import pytest

import __spark_entry__ as contract
from pricemesh.operators import sorting

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "offer_rollup", "offers_filtered", "offers_sorted_delivery_fastest", "group_sort_rating_asc", "delivery_info",
    "title_tokens", "attributes_inferred", "search_results", "requested_pairs", "canonical_products", "feed_shopping",
    "title_identity", "rule_relevance", "enrich_notes", "stream_upsert", "feed_marketplace", "snapshots", "enrich_added", "store_resolution",
    "rule_groups", "rule_pairs", "rule_results", "search_pages", "snapshot_asof", "explanations",
    "product_detail", "product_images", "product_similar", "presentation", "store_union", "point_lookup", "match_requests", "title_contains",
]


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, folder, name):
    df = contract.queries()[name](spark, folder)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(contract.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_unknown_sort_is_refused():
    with pytest.raises(ValueError):
        sorting.check_sort("best")
