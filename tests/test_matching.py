"""Scoring, candidate tiles, components and groups against brute force."""

import random

from pyspark.sql import functions as F

from pricemesh.config import MatchConfig
from pricemesh.operators import candidates, components, explain, products, profiles, scoring
from pricemesh.plans import catalog
from pricemesh.session import cut_lineage
from pricemesh.sources import tables

ROW = """listing_id string, position bigint, title string, description string, brand string, category string,
image_url string, image_hash string, review_count bigint, marketplace string, product_attributes map<string,string>"""


def _rows(spark, rows):
    full = [(f"L{i}", i, t, d, b, c, f"/i/{i}", h, 10 * i, f"m{i % 3}", a) for i, (t, d, b, c, h, a) in enumerate(rows)]
    return spark.createDataFrame(full, ROW)


H = "ffff0000ffff0000"
SHOP = [
    ("Nike Court Vision Low White Sneakers UK 9", "", "Nike", "sneakers", H, {"colour": "White", "size": "UK 9"}),
    ("Nike Court Vision Low White Sneakers UK 9", "shoe", "Nike", "Shoes", H, {"colour": "White", "size": "UK 9"}),
    ("Nike Court Vision Low White Sneakers", "", "Nike", "sneakers", H, {"colour": "White", "size": "UK 8"}),
    ("Court Vision Low White Sneakers UK 9", "", "Adidas", "sneakers", H, {"colour": "White", "size": "UK 9"}),
    ("Court Vision Low White Sneakers UK 7", "", None, None, H, {"colour": "White", "size": "UK 7"}),
    ("Black Cotton Hoodie", "", None, "hoodie", "00000000000000ff", {"material": "Cotton"}),
    ("Black Cotton Sweatshirt", "", None, "sweatshirt", "00000000000000fe", {"material": "Cotton"}),
    ("Black Fleece Hoodie", "", None, "hoodie", "00000000000000ff", {"material": "Fleece"}),
    ("Plain thing", "", None, None, "", {}),
    ("Plain thing", "", None, None, "", {}),
    ("Black Cotton Hoodie", "long text", None, "hoodie", "00000000000000ff", {"material": "Cotton"}),
]


def _pairs(df):
    return {(r.profile_a, r.profile_b): (r.combined_score, r.match_type) for r in df.collect()}


def test_tiles_lose_no_pair(spark):
    """Small cells and blocks give the same pairs as scoring every candidate of the plain rule."""
    cfg = MatchConfig(cell_rows=2)
    weighted = cut_lineage(profiles.weighted(cut_lineage(profiles.profiles(profiles.members(_rows(spark, SHOP)))), cfg))
    got = scoring.score_profiles(candidates.candidate_pairs(weighted, cfg), weighted, cfg).filter("profile_a <> profile_b")
    x, y = (weighted.select(*[F.col(c).alias(c + s) for c in ("profile_id", "category", "title_tokens")]) for s in "xy")
    plain = x.join(y, F.col("profile_idx") < F.col("profile_idy")).filter(
        F.col("categoryx").eqNullSafe(F.col("categoryy")) | F.arrays_overlap("title_tokensx", "title_tokensy")
    ).select(F.col("profile_idx").alias("profile_a"), F.col("profile_idy").alias("profile_b"))
    want = scoring.score_requested(plain, weighted, cfg).filter(F.col("match_type") != scoring.DIFFERENT)
    assert _pairs(got) == _pairs(want) and len(_pairs(want)) >= 4


def test_scored_cases(spark):
    built = catalog.build(_rows(spark, SHOP))
    product = {r.listing_id: r.product_id for r in built.membership().collect()}
    assert product["L0"] == product["L1"] and product["L5"] == product["L10"]
    assert product["L2"] != product["L0"] and product["L3"] != product["L0"] and product["L6"] != product["L5"]
    assert product["L8"] != product["L9"]     # without a hash equal listings are only similar
    scored = _pairs(built.pairs)
    assert scored[(0, 2)][1] == "SIMILAR" and scored[(0, 2)][0] <= 0.89
    assert scored[(8, 8)][1] == "SIMILAR"
    told = {r.class_id: r for r in built.explanations().collect()}
    assert told[0].pair_count == 1 and told[0].confidence >= 90
    assert ("Same brand", "ok") in [(x.label, x.status) for x in told[0].reasons]
    similar = {(r.class_id, r.other_class): r.similarity for r in built.similar().collect()}
    assert similar[(0, 2)] == similar[(2, 0)] and 70 <= similar[(0, 2)] < 90 and (8, 8) in similar
    shown = {r.product_id: r for r in built.products().collect()}
    assert shown[5].description == "long text" and shown[5].canonical_image == "/i/10" and shown[5].listing_count == 2
    edges = built.membership().select("profile_id", "position", "listing_id")
    listed = {(r.listing_a, r.listing_b) for r in scoring.expand_pairs(built.pairs, edges).collect()}
    assert {("L0", "L1"), ("L8", "L9"), ("L5", "L10"), ("L0", "L2"), ("L1", "L2")} <= listed


def test_wording_follows_listing_order_of_interleaved_copies(spark):
    a = ("Red Tee", "", "Acme", "tee", H, {"material": "Cotton"})
    b = ("Red Tee", "", "Acme", "tee", H, {"material": "Polyester"})
    cfg = MatchConfig(exact=0.8)
    built = catalog.build(_rows(spark, [a, b, a, b]), cfg)
    positions = built.membership().select("profile_id", "position")
    pairs = explain.exact_pairs_in_groups(built.pairs, built.classes).filter("profile_a <> profile_b")
    (row,) = explain._directed(pairs, positions).collect()
    assert (row.n_pairs, row.n_forward) == (4, 3)     # 0-1, 0-3, 2-3 forward; 1-2 backward


def test_components_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200)]
    rng.shuffle(chain)
    want = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    for parts in (1, 7):
        edges = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain], "a bigint, b bigint")
        got = components.connected_components(edges.repartition(parts), "a", "b")
        assert {r.node: r.component for r in got.collect()} == want


def test_thresholds_are_parameters(spark):
    row = spark.range(1).select(
        scoring.classify(F.lit(0.8)).alias("a"), scoring.classify(F.lit(0.8), 0.75, 0.5).alias("b"), scoring.classify(F.lit(0.5)).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == ("SIMILAR", "EXACT_MATCH", "DIFFERENT")


def test_summary_counts(spark, folder):
    built = catalog.build(tables.catalog(spark, folder))
    got = {r.measure: r.value for r in products.batch_summary(built.members, built.products(), built.pairs).collect()}
    assert got["listings"] == 200 and got["marketplaces"] == 7 and got["products"] == 200
