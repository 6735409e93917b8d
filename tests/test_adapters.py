"""Stores united into one catalog, and lookups in it."""

import pytest

from pricemesh.sources import adapters


def _store(tmp_path, spark, slug, rows, schema):
    folder = str(tmp_path / slug)
    spark.createDataFrame(rows, schema).write.parquet(folder)
    return adapters.StoreAdapter(slug, lambda s: s.read.parquet(folder))


@pytest.fixture
def stores(spark, tmp_path):
    return [
        _store(tmp_path, spark, "one", [("a", 1, "Pan", "2.5"), ("a", 0, "Pot", "3"), ("b", 2, None, None)], "listing_id string, position bigint, title string, price string"),
        _store(tmp_path, spark, "two", [("a", "other", 9.0, "x")], "listing_id string, marketplace string, price double, extra string"),
        _store(tmp_path, spark, "none", [], "listing_id string"),
    ]


def test_union_has_the_listing_columns_and_the_stores_own_slug(spark, stores):
    got = adapters.union_stores(spark, stores)
    rows = sorted((r["marketplace"], r["listing_id"], r["title"] or "", r["price"]) for r in got.filter("price is not null").collect())
    assert rows == [("one", "a", "Pan", 2.5), ("one", "a", "Pot", 3.0), ("two", "a", "", 9.0)]
    assert got.count() == 4 and "extra" not in got.columns
    assert adapters.union_stores(spark, []).columns == got.columns
    with pytest.raises(ValueError):
        adapters.union_stores(spark, [stores[0], stores[0]])


def test_a_filter_on_the_store_leaves_the_others_unread(spark, stores):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(adapters.union_stores(spark, stores).filter("marketplace = 'one' and listing_id = 'a'").select("title"))
    assert one.count("FileScan") == 1 and "EqualTo(listing_id,a)" in one


def test_lookups_answer_every_request_once(spark, stores):
    asked = [("one", "a"), ("one", "a"), ("two", "a"), ("two", "b"), ("nowhere", "a"), (None, "a"), ("one", None)]
    found = adapters.point_lookup(spark.createDataFrame(asked, "marketplace string, listing_id string"), adapters.union_stores(spark, stores))
    got = {(r["marketplace"], r["listing_id"]): (r["title"], r["price"]) for r in found.collect()}
    assert got.pop(("one", "a")) == ("Pot", 3.0) and got.pop(("two", "a")) == (None, 9.0)
    assert got == {("two", "b"): (None, None), ("nowhere", "a"): (None, None), (None, "a"): (None, None), ("one", None): (None, None)}
    assert found.count() == 6
