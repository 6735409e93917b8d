"""Text, attributes, identity, stores and delivery on small restated cases."""

from pyspark.sql import functions as F

from pricemesh.functions import delivery, display, identity, stores, text
from pricemesh.functions.attributes import with_attributes

LISTING = "title string, description string, brand string, category string, product_attributes map<string,string>"


def _attrs(spark, *rows):
    df = with_attributes(spark.createDataFrame(list(rows), LISTING))
    return [r.attributes for r in df.collect()]


def test_ram_and_storage_are_split_and_5g_is_no_quantity(spark):
    (a,) = _attrs(spark, ("Redmi Note 15 5G (Mist Purple, 8GB RAM, 128GB Storage)", "", None, None, {}))
    assert a["ram"] == "8 gb" and a["storage"] == "128 gb" and "quantity" not in a


def test_supplied_values_win_and_last_repeat_counts(spark):
    a, b = _attrs(
        spark,
        ("Mascara Black 7.2ml", "", "Maybelline New York", "Shoes", {"Color": "Crystal Clear", "size": ""}),
        ("White sneaker", None, "Generic", None, {"size": "UK 9", "shade": "MR1 Red Coat", "quantity": "3.6g"}),
    )
    assert a == {"colour": "clear", "quantity": "7.2 ml", "brand": "maybelline", "category": "sneakers"}
    assert b["size"] == "9" and b["shade"] == "mr1" and b["quantity"] == "3.6 g" and "brand" not in b


def test_longest_option_first_and_substring_aliases(spark):
    (a,) = _attrs(spark, ("navy dark blue television tee", "", None, None, None))
    assert a["colour"] == "dark indigo"
    row = spark.createDataFrame([("Television (32W x 32L) - UK 9 Size 8",)], "t string").select(
        text.normalize_title(F.col("t")).alias("n"), text.tokens(F.lit("Women's Glasses x Shoes 42s")).alias("t")
    ).first()
    assert row.n == "televi'sion 32 9 8"
    assert row.t == ["women", "glasse", "shoe", "42s"]


def test_an_earlier_lone_letter_hides_a_later_size(spark):
    a, b = _attrs(spark, ("men's tee xl", "", None, None, None), ("tee xl", "", None, None, None))
    assert "size" not in a and b["size"] == "xl"


def test_clean_titles(spark):
    row = spark.range(1).select(
        text.clean_title(F.lit("Ubtan Face Wash (tube) Saffron, 100ml")).alias("a"),
        text.clean_rule_title(F.lit("Phone [Duplicate-82] 128 GB | ")).alias("b"),
    ).first()
    assert row.a == "Ubtan Face Wash Saffron" and row.b == "Phone 128 GB"


def test_accessories_are_flagged_only_when_not_asked_for(spark):
    q = "motorola edge 50 fusion"
    flagged = ["Motorola Edge 50 Fusion Battery", "for Motorola Edge 50 Fusion Case, clear", "LCD Screen for Motorola Edge 50 Fusion"]
    plain = ["Motorola Edge 50 Fusion (Forest Blue, 12GB RAM, 256GB Storage)", "MOTOROLA Edge 50 Fusion 5G 256GB"]
    df = identity.with_identity(spark.createDataFrame([(t, q) for t in flagged + plain], "title string, q string"), "title")
    got = {r.title: r.a for r in df.select("title", identity.is_accessory(F.col("identity"), identity.query_words(F.col("q"))).alias("a")).collect()}
    assert all(got[t] for t in flagged) and not any(got[t] for t in plain)


def test_store_names(spark):
    listed = {
        "Amazon.in": "amazon", "JioMart Grocery": "jiomart", "NIKE India": "nike", "Foot Locker": "footlocker",
        "www.tatacliq.com": "tatacliq", "Apple Store": "apple", "Samsung Shop": "samsung", "H&M": "hm",
        "Reliance Trends": "reliance-trends", "Swiggy Instamart": "swiggy-instamart", "Croma - Electronics": "croma",
    }
    other = ["Purplle.com - Beauty Online", "ubuy.co.in", "Cashify", "iCrescent Apple Authorised Store", "Apple Fan Club"]
    df = stores.with_store(spark.createDataFrame([(s,) for s in [*listed, *other]], "s string"), "s")
    got = {r.s: r.listed_slug for r in df.collect()}
    assert {s: got[s] for s in listed} == listed
    assert all(got[s] is None for s in other)


def test_delivery_texts(spark):
    told = {
        "Free delivery tomorrow": 1, "Delivery in 3 days": 3, None: 99, "Free 10 min delivery": 0, "Free delivery": 99,
        "Delivery in 2-4 days": 4, "by Feb 30": 99, "by 29 feb": 99, "month end": 6, "Get it Tue": 7, "by Dec 3": 2,
        "by 30 Nov": 364, "in\u00a03\u00a0days": 3, "10\u00a0min delivery": 0, "\u2007by 2\u00a0Dec\u00a0": 1,
    }
    df = delivery.with_delivery_days(
        spark.createDataFrame([(t,) for t in told], "t string"), "t", F.lit("2026-12-01").cast("date")
    )
    assert {r.t: r.delivery_days for r in df.collect()} == told


def test_small_display_rules(spark):
    row = spark.range(1).select(
        display.compact_number(F.lit(1250)).alias("k"), display.compact_number(F.lit(310000)).alias("l"),
        display.discount(F.lit(499.0), F.lit(699.0)).alias("d"), display.discount(F.lit(5.0), F.lit(0.0)).alias("z"),
        display.is_converted_price(F.lit(112779.14)).alias("f"), display.location_pincode(F.lit("282 001")).alias("p"),
        display.subtitle(F.create_map(F.lit("ram"), F.lit("8 gb"), F.lit("colour"), F.lit("sky blue"))).alias("s"),
    ).first()
    assert (row.k, row.l, row.d, row.z, row.f, row.p, row.s) == ("1.3k", "3.1L", 28.6, 0.0, True, "282001", "8 gb · Sky Blue")
