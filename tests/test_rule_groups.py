"""The streamed grouping pass against a plain pass over all pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.operators import ranking, rulegroup
from pricemesh.plans import queries
from pricemesh.session import shared_folder

FACTS = ["brand", "storage", "ram", "colour", "quantity"]


def stand_together(a, b, cfg=RuleConfig()):
    if any(a[f] and b[f] and a[f] != b[f] for f in FACTS):
        return False
    speaks = any(x[f] for x in (a, b) for f in ("storage", "colour", "quantity"))
    ratio = max(a["price"], b["price"]) / max(1.0, min(a["price"], b["price"]))
    if ratio > (cfg.price_ratio if speaks else cfg.vague_price_ratio):
        return False
    x, y = set(a["family"]), set(b["family"])
    if not a["model"]:
        return bool(x & y) and 2 * len(x & y) / (len(x) + len(y)) >= cfg.family_dice
    return not x or not y or bool(x & y)


def plain_pass(rows, cfg=RuleConfig()):
    groups, out = [], []
    for r in rows:
        options = [g for g in groups if all(stand_together(m, r) for m in g)]
        if len(options) > 1 and not r["specificity"]:
            near = [g for g in options if abs(r["price"] - min(m["price"] for m in g)) / max(1.0, r["price"]) <= cfg.near_price]
            options = near if len(near) == 1 else []
        if not options:
            options = [[]]
            groups.append(options[0])
        options[0].append(r)
        out.append(options[0][0]["listing_id"])
    return out


def random_block(r, n, model):
    pick = lambda *values: r.choice([None, None, *values])
    rows = []
    for i in range(n):
        row = {f: pick(f"{f}1", f"{f}2") if r.random() < 0.6 else None for f in FACTS}
        row |= {"listing_id": f"l{i}", "model": model, "family": r.sample(["pro", "air", "mini", "max"], r.randint(0, 3))}
        row["price"] = r.choice([0.0, 0.4, 50.0, 100.0, 104.9, 105.0, 110.0, 115.0, 116.0, 160.0, 161.0, float(r.randint(80, 200))])
        row["specificity"] = sum(bool(row[f]) for f in ("storage", "ram", "colour", "quantity"))
        rows.append(row)
    return sorted(rows, key=lambda x: -x["specificity"])


@pytest.mark.parametrize("model", [[], ["16"]])
def test_streamed_pass_equals_the_plain_pass(model):
    r = random.Random(len(model))
    for _ in range(1000):
        rows = random_block(r, r.randint(1, 40), model)
        state = rulegroup.GroupState(RuleConfig())
        assert [state.place(x) for x in rows] == plain_pass(rows)


def test_a_block_of_vague_rows_streams_through(spark):
    """20,000 listings of one query that state no variant, prices close together: one block, few groups, no pair kept."""
    rows = spark.range(20_000).select(
        F.lit("q").alias("query_id"), F.lit("acme ultra 16").alias("query"), F.concat(F.lit("id"), "id").alias("listing_id"), F.lit("Acme Ultra 16").alias("title"),
        (10_000 + F.col("id") * 7919 % 6_000).cast("double").alias("price"), F.concat(F.lit("store"), F.col("id") % 50).alias("marketplace"), F.col("id").cast("double").alias("position"),
        F.lit(99).alias("delivery_days"), F.lit("").alias("image_url"),
    )
    grouped = rulegroup.assign_groups(rulegroup.identified(rows))
    got = {x["listing_id"]: x["group_id"] for x in grouped.select("listing_id", "group_id").collect()}
    state = rulegroup.GroupState(RuleConfig())
    plain = [dict(brand="acme", storage=None, ram=None, colour=None, quantity=None, listing_id=f"id{i}", model=["16"], family=["ultra"], price=float(10_000 + i * 7919 % 6_000), specificity=0) for i in range(20_000)]
    assert got == {x["listing_id"]: state.place(x) for x in plain}
    assert plain_pass(plain[:400]) == [got[x["listing_id"]] for x in plain[:400]]


def test_rank_is_the_place_in_the_united_feeds(spark):
    row = lambda i, direct, position, title, price: ("q", "acme 16", i, title, price, f"s{i}", position, 99, "", direct)
    rows = [row("m", True, 1.5, "Acme 16 128GB", 100.0), row("a", False, 3.0, "Acme 16 256GB", 120.0), row("b", False, 40.0, "Acme 16 512GB", 150.0), row("n", True, 2.5, "Acme 16 512GB", 150.0)]
    df = spark.createDataFrame(rows, "query_id string, query string, listing_id string, title string, price double, marketplace string, position double, delivery_days int, image_url string, direct boolean")
    groups = rulegroup.rule_groups(rulegroup.one_offer_per_store(rulegroup.assign_groups(rulegroup.identified(df))))
    assert [g["canonical_title"] for g in groups.orderBy("rank").collect()] == ["Acme 16 256GB", "Acme 16 512GB", "Acme 16 128GB"]
    shown = ranking.final_groups(groups.withColumns({"relevance": F.lit(1.0), "flags": F.array().cast("array<string>")}))
    assert [g["canonical_title"] for g in shown.orderBy("place").collect()] == ["Acme 16 256GB", "Acme 16 512GB", "Acme 16 128GB"]


def test_equal_rows_of_a_feed_count_once(spark):
    rows = [("q", "acme 16", "x", "Acme 16 128GB", p, "s", 1.0, 99, "") for p in (110.0, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "query_id string, query string, listing_id string, title string, price double, marketplace string, position double, delivery_days int, image_url string")
    assert [r["price"] for r in rulegroup.identified(df).collect()] == [100.0]


def test_a_block_of_many_groups_equals_the_plain_pass():
    """Few groups are gone through one by one, more of them as arrays: both and the change between them place alike."""
    r = random.Random(5)
    for _ in range(20):
        rows = random_block(r, 250, ["16"])
        for row in rows:
            row["family"] = r.sample([f"w{i}" for i in range(30)], r.randint(1, 2))
        state = rulegroup.GroupState(RuleConfig())
        assert [state.place(x) for x in rows] == plain_pass(rows)
        assert len(state.held) > rulegroup._FEW


def small_tables(spark, folder, lines=600):
    """The tables that offers are read from, a few rows each."""
    k = F.col("id")
    rows = {
        "part": spark.range(30).select(k.alias("p_partkey"), F.concat(F.lit("hot bolt "), k % 4).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), (k % 3 + 1).cast("int").alias("p_size"), F.lit(9.0).alias("p_retailprice")),
        "supplier": spark.range(20).select(k.alias("s_suppkey"), F.concat(F.lit("S"), k).alias("s_name"), (k % 5).cast("int").alias("s_nationkey")),
        "nation": spark.range(5).select(k.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), k).alias("n_name")),
        "orders": spark.range(50).select(k.alias("o_orderkey"), F.lit("1998-02-06").cast("timestamp").alias("o_orderdate")),
        "lineitem": spark.range(lines).select((k % 50).alias("l_orderkey"), (k % 30).alias("l_partkey"), (k * 7 % 20).alias("l_suppkey"), (k % 9 + 1.0).alias("l_quantity"), (k % 97 * 100.0 + 900).alias("l_extendedprice"), F.lit("1998-02-09").cast("timestamp").alias("l_shipdate")),
    }
    for name, df in rows.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def test_queries_are_grouped_in_slices(spark, monkeypatch, tmp_path):
    """Slices of whole queries give the groups of the whole, and leave nothing but the offers behind."""
    folder = str(tmp_path)
    small_tables(spark, folder)
    whole = sorted(map(tuple, queries.rule_groups(spark, folder).collect()))
    monkeypatch.setattr(queries, "SLICE_ROWS", 250)
    cut = sorted(map(tuple, queries.rule_groups(spark, folder).collect()))
    assert whole and cut == whole
    left = os.listdir(shared_folder(spark).removeprefix("file:"))
    assert not [f for f in left if f.startswith(("rule-feeds", "rule-slice"))]
