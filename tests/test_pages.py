"""Sorts read from the row, explanations of found listings, and requests against snapshots, by plain versions."""

import random
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.operators import explain, ingest, sorting
from pricemesh.operators.asof import latest_before

GROUP = """product_id bigint, group_position bigint, price_min double, price_max double, fastest_days int, slowest_days int,
rating_min double, rating_max double, discount_max double, relevance double, listing_count bigint"""


def test_groups_of_many_sorts_are_ordered_as_one_sort_at_a_time(spark):
    rng = random.Random(5)
    maybe = lambda v: None if rng.random() < 0.2 else v
    few = lambda: maybe(float(rng.randint(0, 3)))
    rows = [
        (i, i, few(), few(), maybe(rng.randint(0, 3)), rng.randint(0, 3), few(), few(), few(), few(), rng.randint(1, 3))
        for i in range(60)
    ]
    groups = spark.createDataFrame(rows, GROUP)
    asked = [*vocab.SORT_KEYS, "best", None]
    wanted = spark.createDataFrame([(str(s), s) for s in asked], "query_id string, sort string")
    mixed = groups.join(wanted, F.lit(True))
    ranked = sorting.rank_within(mixed, ["query_id"], sorting.requested_group_order(F.col("sort")), "place")
    got = {}
    for r in ranked.collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["product_id"]))
    assert len(got) == len(asked)
    for name in asked:
        plain = groups.orderBy(*sorting.group_order(name)).select("product_id").collect()
        assert [p for _, p in sorted(got[str(name)])] == [r[0] for r in plain], name


def test_listing_key_of_the_row_orders_as_the_named_sort(spark):
    rng = random.Random(6)
    rows = [
        (i, float(rng.randint(1, 3)), rng.randint(0, 2), rng.choice(["in_stock", "out_of_stock"]), float(rng.randint(1, 3)),
         rng.randint(0, 2), float(rng.randint(0, 2)), float(rng.randint(0, 2)))
        for i in range(50)
    ]
    listings = spark.createDataFrame(
        rows, "position bigint, price double, delivery_days int, availability string, rating double, review_count bigint, discount_percentage double, relevance double"
    )
    for name in vocab.SORT_KEYS:
        by_row = listings.orderBy(sorting.requested_listing_key(F.lit(name))).select("position").collect()
        plain = listings.orderBy(*sorting.listing_order(name)).select("position").collect()
        assert by_row == plain, name


PAIR = """profile_a bigint, profile_b bigint, n_pairs bigint, last_position_a bigint, text_score double, attribute_score double,
image_score double, combined_score double, match_type string"""


def test_found_explanations_count_only_pairs_of_found_listings(spark, monkeypatch):
    """Against every pair of found listings, one by one; copies interleave and one wording names both values."""
    entry = lambda label, status: F.struct(label.alias("label"), F.lit(status).alias("status"))
    worded = lambda x, y: F.concat(F.lit("Colour differs ("), F.col(f"profile_{x}"), F.lit(" vs "), F.col(f"profile_{y}"), F.lit(")"))
    said = lambda x="a", y="b": F.array(entry(F.lit("Same brand"), "ok"), entry(worded(x, y), "warn"))
    monkeypatch.setattr(explain, "reasons", said)
    profile_of = {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 9: 9, 10: 9}
    scores = {(1, 1): 0.99, (1, 2): 0.93, (9, 9): 1.0}
    rows = [(a, b, 0, max(p for p, q in profile_of.items() if q == a), s, s, s, s, "EXACT_MATCH") for (a, b), s in scores.items()]
    pairs = spark.createDataFrame(rows + [(2, 9, 0, 4, 0.8, 0.8, 0.8, 0.8, "SIMILAR")], PAIR)
    classes = spark.createDataFrame([(1, 1, True), (2, 1, True), (9, 9, True)], "profile_id bigint, class_id bigint, merged boolean")
    hits = {"all": [1, 2, 3, 4, 5, 9, 10], "some": [2, 3, 4], "one": [5, 9]}
    found = spark.createDataFrame(
        [(q, profile_of[p], p) for q, ps in hits.items() for p in ps], "query_id string, profile_id bigint, position bigint"
    )
    got = {(r["query_id"], r["class_id"]): r for r in explain.found_explanations(pairs, classes, found).collect()}
    want = {}
    for query, positions in hits.items():
        for x, y in combinations(sorted(positions), 2):
            a, b = profile_of[x], profile_of[y]
            score = scores.get((min(a, b), max(a, b)))
            if score is not None:
                want.setdefault((query, 1 if a < 9 else 9), []).append((score, f"Colour differs ({a} vs {b})"))
    assert set(got) == set(want)
    for group, seen in want.items():
        assert got[group]["pair_count"] == len(seen)
        assert abs(got[group]["text"] - sum(s for s, _ in seen) / len(seen)) < 6e-4
        labels = [label for _, label in seen]
        warned = {x for x in labels if labels.count(x) * 3 >= max(3, len(seen))}
        assert {r["label"] for r in got[group]["reasons"] if r["status"] == "warn"} == warned
        assert [r["label"] for r in got[group]["reasons"] if r["status"] == "ok"] == ["Same brand"]


REQUEST = "event_id bigint, query_key string, asked_at timestamp, failed boolean, state string"
SNAPSHOT = "query_key string, product_ids array<bigint>, fetched_at timestamp"


def test_requests_meet_the_snapshot_of_their_time(spark):
    """A hot key over all partitions, keys without snapshots, equal times, nulls; against a plain scan."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    at = lambda: None if rng.random() < 0.05 else start + timedelta(hours=rng.randint(0, 200))
    requests = [(i, key(), at(), rng.choice([True, False, None]), "x") for i in range(400)]
    snapshots = [(k, [i], t) for i, (k, t) in enumerate({(rng.choice(["hot", "hot", "a", None]), at()) for _ in range(60)})]
    requests += requests[:3]
    found = ingest.served_snapshots(
        spark.createDataFrame(requests, REQUEST).drop("state"), spark.createDataFrame(snapshots, SNAPSHOT)
    )
    want = []
    for event, k, asked, failed, _ in requests:
        known = [(t, ids) for s, ids, t in snapshots if k is not None and s == k and t is not None and asked is not None and t <= asked]
        taken, ids = max(known) if known else (None, None)
        if known and asked - taken < timedelta(hours=6):
            outcome = "fresh"
        elif not failed:
            outcome = "fetch"
        else:
            outcome = "stale" if known else "empty"
        served = outcome in ("fresh", "stale")
        want.append((event, outcome, ids if served else None, taken if served else None))
    got = [(r["event_id"], r["outcome"], r["product_ids"], r["fetched_at"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {o for _, o, _, _ in want} == {"fresh", "fetch", "stale", "empty"}


def test_as_of_join_keeps_requests_without_states_and_clashing_columns(spark):
    requests = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), False, "mine"), (2, None, None, True, None)], REQUEST)
    states = spark.createDataFrame([("a", [1], datetime(2023, 1, 1))], SNAPSHOT)
    joined = latest_before(requests, states.withColumnRenamed("fetched_at", "asked_at"), "query_key", "asked_at", "asked_at", "found")
    got = {r["event_id"]: r for r in joined.collect()}
    assert got[1]["state"] == "mine" and got[1]["found"]["product_ids"] == [1] and got[2]["found"] is None
    empty = latest_before(requests, states.filter("false"), "query_key", "asked_at", "fetched_at", "found")
    assert [r["found"] for r in empty.collect()] == [None, None]
    mapped = states.withColumn("facts", F.create_map(F.lit("a"), F.lit(1)))
    assert latest_before(requests, mapped, "query_key", "asked_at", "fetched_at", "found").filter("found.facts['a'] = 1").count() == 1
    assert latest_before(requests.filter("false"), states, "query_key", "asked_at", "fetched_at", "found").collect() == []
