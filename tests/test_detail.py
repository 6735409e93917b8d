"""The product page on a catalog with copies that stay apart, listing by listing."""

import pytest
from pyspark.sql import functions as F

from pricemesh.functions import display
from pricemesh.plans import catalog, detail

ROW = """listing_id string, position bigint, title string, description string, brand string, category string, image_url string,
image_hash string, review_count bigint, marketplace string, product_attributes map<string,string>, price double, mrp double,
rating double, delivery_days int, availability string"""
H = "ffff0000ffff0000"
#: Three copies without a hash, two merged copies of the same title, another colour of it, and a thing of its own.
SHOP = [("Blue Steel Bottle", "", "blue")] * 3 + [("Blue Steel Bottle", H, "blue")] * 2 + [("Blue Steel Bottle", H, "green"), ("Red Lamp", H, "red")]


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        (f"L{i}", i, title, "", "Acme", "home", f"/i/{i % 2}", h, 10 * i, f"m{i % 2}", {"colour": colour}, 90.0 - i, 100.0, 4.0, i, "in_stock")
        for i, (title, h, colour) in enumerate(SHOP)
    ]
    return catalog.build(spark.createDataFrame(rows, ROW))


def test_copies_that_stay_apart_are_similar_to_each_other(spark, built):
    product = {r["listing_id"]: r["product_id"] for r in built.membership().collect()}
    assert [product[f"L{i}"] for i in range(7)] == [0, 1, 2, 3, 3, 5, 6]
    got = {}
    for r in detail.product_similar(built).collect():
        got.setdefault(r["product_id"], []).append((r["place"], -r["similarity"], r["other_product"], r["listing_count"]))
    others = {p: {o for _, _, o, _ in rows} for p, rows in got.items()}
    assert others[0] >= {1, 2, 3} and others[1] >= {0, 2, 3} and 0 not in others[0] and 6 not in got
    for rows in got.values():
        rows.sort()
        assert [p for p, _, _, _ in rows] == list(range(1, len(rows) + 1))
        assert {(o, n) for _, _, o, n in rows} <= {(0, 1), (1, 1), (2, 1), (3, 2), (5, 1)}
    details = {r["product_id"]: r for r in detail.product_details(built).collect()}
    assert set(details) == {0, 1, 2, 3, 5, 6}
    for p, row in details.items():
        rows = got.get(p, [])
        assert row["n_similar"] == len(rows)
        assert row["all_listings"] == row["listing_count"] + sum(n for _, _, _, n in rows)
    assert details[3]["listing_count"] == 2 and details[3]["confidence"] is not None and details[0]["confidence"] is None


def test_only_requested_products_are_shown(spark, built):
    asked = spark.createDataFrame([(3,), (3,), (77,), (None,)], "product_id bigint")
    assert [r["product_id"] for r in detail.product_details(built, asked).collect()] == [3]
    assert {r["product_id"] for r in detail.product_similar(built, asked).collect()} == {3}
    images = sorted((r["image_rank"], r["image_url"]) for r in detail.product_images(built, asked).collect())
    assert images == [(1, "/i/0"), (2, "/i/1")]     # L4 is the cheaper one
    assert detail.product_details(built, asked.filter("false")).count() == 0


def test_capitals_at_word_starts_only(spark):
    told = ["wi-fi blue", "o'neill", "McCoy navy", "éa b", "", "snake_case", " two  blanks"]
    rows = spark.createDataFrame([(v,) for v in told], "v string").select(display.capitalised(F.col("v")).alias("c"))
    assert [r["c"] for r in rows.collect()] == ["Wi-Fi Blue", "O'Neill", "McCoy Navy", "éA B", "", "Snake_case", " Two  Blanks"]
