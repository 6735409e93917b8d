"""Pairs asked for by id or sent along, and the statistics they are weighed by."""

from pyspark.sql import functions as F

from pricemesh.plans import catalog, requests
from pricemesh.sources import sinks

ROW = """listing_id string, position bigint, title string, description string, brand string, category string,
image_url string, image_hash string, product_attributes map<string,string>"""
SENT = "request_id string, side string, " + ROW.split(", ", 2)[2] + ", listing_a string"
H = "0f0f0f0f0f0f0f0f"
SHOP = [
    ("A", 1, "Orvane Trail Lantern", "", "Orvane", "lantern", "", H, {"colour": "Green", "size": "20"}),
    ("B", 2, "Orvane Trail Lantern", "", "Orvane", "lantern", "", H, {"colour": "Green", "size": "20"}),
    ("C", 3, "Orvane Trail Lantern", "", "Orvane", "lantern", "", H, {"colour": "Green", "size": "40"}),
    ("D", 4, "Pellmore Kettle", None, None, None, None, None, None),
]


def _asked(spark, rows):
    return spark.createDataFrame(rows, "request_id string, listing_a string, listing_b string")


def test_pairs_by_id_and_by_row(spark, tmp_path):
    shop = spark.createDataFrame(SHOP, ROW)
    asked = _asked(spark, [
        ("same", "A", "B"), ("self", "A", "A"), ("sizes", "A", "C"), ("sizes", "C", "A"), ("sent", "A", None), ("both", None, None), ("known wins", "A", "B"),
        ("gone", "A", "Z"), ("empty", "D", None), ("nothing", None, None), (None, "A", None), (None, "A", "B"),
    ])
    green = {"colour": "Green"}
    sent = spark.createDataFrame([
        ("sent", "b", "Orvane Trail Lantern", "", "Orvane", "lantern", "", H, {**green, "size": "20"}, "clash"),
        ("both", "a", "Orvane Zyx", "", "Orvane", "lantern", "", H, green, "clash"), ("both", "b", "Orvane Zyx", "", "Orvane", "lantern", "", H, green, "clash"),
        ("known wins", "b", "Other", "", "Else", "kettle", "", "", {}, "clash"), ("empty", "b", None, None, None, None, None, None, None, None),
        ("empty", "b", None, None, None, None, None, None, None, None), (None, "b", "Lost", "", "", "", "", "", {}, "clash"),
    ], SENT)
    idf = requests.catalog_statistics(shop)
    got = requests.match_requests(asked, sent, shop, idf).collect()
    assert len(got) == asked.count()
    kind = {(r.request_id, r.listing_a, r.listing_b): (r.outcome, r.match_type) for r in got}
    assert kind["same", "A", "B"] == kind["self", "A", "A"] == kind["sent", "A", "adhoc-b"] == ("scored", "EXACT_MATCH")
    assert kind["both", "adhoc-a", "adhoc-b"] == kind["known wins", "A", "B"] == kind[None, "A", "B"] == ("scored", "EXACT_MATCH")
    assert kind["sizes", "A", "C"] == kind["sizes", "C", "A"] == ("scored", "SIMILAR")
    assert kind["gone", "A", "Z"] == kind["nothing", None, None] == kind[None, "A", None] == ("missing", None)
    assert kind["empty", "D", "adhoc-b"][0] == "scored"
    told = {(r.listing_a, r.listing_b): [x.label for x in r.reasons] for r in got if r.request_id == "sizes"}
    assert any("20" in x and "40" in x and x.index("20") < x.index("40") for x in told["A", "C"])
    assert any("20" in x and "40" in x and x.index("40") < x.index("20") for x in told["C", "A"])

    # The scores of the batch, whose statistics are the same.
    _, _, pairs = catalog.match_pairs(shop)
    batch = {(r.profile_a, r.profile_b): r.combined_score for r in pairs.collect()}
    assert {r.combined_score for r in got if r.request_id == "sizes"} == {batch[1, 3]}
    none = requests.match_requests(asked.limit(0), sent, shop, idf)
    assert none.count() == 0 and {"text_score", "weights", "thresholds"} <= set(none.columns)


def test_long_titles_and_an_empty_catalog(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    sent = spark.createDataFrame([("r", s, long + s, "", "", "", "", "", {}, "") for s in "ab"], SENT)
    shop = spark.createDataFrame([], ROW)
    row = requests.match_requests(_asked(spark, [("r", "A", None)]), sent, shop, requests.catalog_statistics(shop)).first()
    assert (row.outcome, row.listing_a, row.listing_b) == ("scored", "adhoc-a", "adhoc-b") and 0.9 < row.text_score <= 1


def test_statistics_by_version(spark, tmp_path):
    shop = spark.createDataFrame(SHOP, ROW)
    folder = str(tmp_path)
    one, two = (requests.catalog_statistics(shop.filter(F.col("position") <= n)) for n in (2, 4))
    for version, idf in ((1, one), (2, two), (1, one)):
        sinks.write_statistics(idf, folder, version)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.read_statistics(spark, folder)) == rows(two)
    assert rows(sinks.read_statistics(spark, folder, 1)) == rows(one) != rows(two)
    weight = dict((r.token, r.idf_micros) for r in two.collect())
    assert weight["lantern"] < weight["kettle"]
