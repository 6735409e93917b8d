"""Plans that keep their cost per row and their spread as tables grow."""

import os
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pricemesh import vocab
from pricemesh.config import MatchConfig
from pricemesh.functions import identity
from pricemesh.llm import toxicity
from pricemesh.operators import embedding, enrich, ingest, offers, profiles, scoring, search, sorting
from pricemesh.session import cut_lineage, filter_here
from pricemesh.sources import derived, feeds, tables
from pricemesh.streaming import upsert as stream


def _written_out(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_file_of_many_rows_is_spread(spark, tmp_path):
    k = F.col("p_partkey")
    rows = spark.range(25_000).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#7").alias("p_brand"),
        F.lit("LARGE").alias("p_type"), F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for read in (tables.catalog, derived.shelf_titles):
        got = read(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() == 3 and got.count() == 25_000
    assert tables.spread(rows.filter(k < 10)).count() == 10


def test_scores_are_not_written_out_again_by_the_filter(spark, folder):
    weighted = cut_lineage(profiles.weighted(cut_lineage(profiles.profiles(profiles.members(tables.catalog(spark, folder)))), MatchConfig()))
    pairs = weighted.selectExpr("profile_id profile_a", "profile_id + 1 profile_b", "0.9D dice", "0.9D cosine")
    scored = scoring.score_profiles(pairs, weighted, MatchConfig())
    assert _written_out(scored).count("zip_with(attrs") == 1
    every = scoring.score(scoring.with_sides(pairs.unionByName(scoring.self_pairs(weighted)), weighted), MatchConfig())
    assert sorted(scored.select("profile_a", "profile_b", "combined_score").collect()) == sorted(
        r[:3] for r in every.select("profile_a", "profile_b", "combined_score", "match_type").collect() if r[3] != scoring.DIFFERENT
    )


def test_filter_here_keeps_what_a_filter_keeps(spark):
    rows = spark.sql("select * from values (1, map('a', 1)), (2, null), (null, map('b', 2)) t(`x.y`, m)")
    got = filter_here(rows, F.col("`x.y`") > 1)
    assert got.columns == rows.columns and got.collect() == rows.filter(F.col("`x.y`") > 1).collect()


def test_the_language_model_rejects_texts_of_no_clear_language(spark, folder):
    rows = [(i, "one text of three languages", ("en", "de", "fr")[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.keep_languages(spark, docs, folder).count() == 0
    assert corpus_pipeline.keep_languages(spark, docs.withColumn("lang", F.lit("en")), folder).count() == 30


def test_the_toxicity_model_is_not_fitted_in_the_driver(spark, monkeypatch):
    def told(texts, labels, prior, config):
        return toxicity.ToxicityModel(config.orders, np.arange(2, dtype=np.uint64), np.array([len(texts), prior]), float(os.getpid()))

    monkeypatch.setattr(toxicity, "fit", told)
    docs = spark.sql("select id doc_id, concat('text ', id) text from range(10)")
    model = toxicity.train(docs, spark.sql("select id doc_id, id % 2 toxic from range(8)"), "doc_id", "text", "toxic")
    assert model.bias != os.getpid() and model.hashes.tolist() == [0, 1] and model.weights.tolist() == [8.0, 0.5]


def test_colour_words_are_split_once_a_title(spark):
    rows = spark.sql("select title from values ('Acme black 16 | 16') t(title)").repartition(2)
    assert "array_contains(split(" not in _written_out(identity.with_identity(rows, "title"))
    found = spark.sql("select * from values ('acme dark blue max 128gb'), ('acme 16 red | x'), ('| acme'), (null) t(title)")
    got = {r["title"]: r["identity"] for r in identity.with_identity(found, "title").collect()}
    assert got["acme dark blue max 128gb"]["storage"] == "128gb" and "blue" not in got["acme dark blue max 128gb"]["family"]
    assert got["acme 16 red | x"]["model"] == ["16"] and got["| acme"]["family"] is not None


def test_embedding_needs_no_join(spark):
    docs = spark.sql("select * from values ('a', 'red bolt'), ('a', 'red'), (null, 'ring'), ('b', '') t(id, text)")
    found = embedding.hashed_embedding(docs)
    assert "Join" not in _written_out(found)
    assert {r.id: round(r.n, 9) for r in found.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {"a": 1.0}


def test_upsert_joins_once(spark):
    known = spark.sql("select * from values ('a', 1L, 9D, 10D, 10D), (null, 2L, 5D, 5D, 0D) t(listing_id, position, price, mrp, discount_percentage)")
    fresh = spark.sql("select * from values ('a', 7L, 5D, 10D), ('b', 8L, 1D, 2D), (null, 9L, 1D, 4D) t(listing_id, position, price, mrp)")
    got = ingest.upsert(known, fresh)
    assert _written_out(got).count("Join ") == 1
    want = [("a", 1, 5.0, 10.0, 50.0), (None, 2, 5.0, 5.0, 0.0), ("b", 8, 1.0, 2.0, 50.0), (None, 9, 1.0, 4.0, 75.0)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_feed_filters_write_no_rule_out(spark, folder):
    rows = feeds.shopping_listings(derived.shopping_rows(spark, folder), F.lit("2026-09-28").cast("date"))
    assert not [x for x in _written_out(rows).splitlines() if "Filter" in x and "regexp_replace" in x]


def _longest_method(df, capsys) -> int:
    """Bytes of code of the longest method Spark generates for the plan; the JVM compiles none of more than 8000."""
    capsys.readouterr()
    df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))


def test_feed_rules_are_compiled(spark, folder, capsys):
    day = F.lit("2026-09-28").cast("date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _longest_method(feeds.shopping_listings(derived.shopping_rows(spark, folder), day), capsys) < 8000
        assert _longest_method(feeds.marketplace_listings(derived.marketplace_rows(spark, folder), day), capsys) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_products_title_is_read_below_the_join(spark, folder):
    judged = enrich.judged(derived.store_offers(spark, folder), tables.offers(spark, folder))
    assert "lower(base_title" not in _written_out(judged).split("Join")[0]


def test_group_sorts_need_only_their_own_columns(spark, folder):
    groups = cut_lineage(offers.rollup(offers.with_discount(tables.offers(spark, folder)), ["product_id"]).withColumn("relevance", F.col("rating_max") / 10))
    for sort in vocab.SORT_KEYS:
        narrow = groups.select("product_id", *sorting.group_columns(sort))
        at = lambda df: sorted(map(tuple, sorting.sort_groups(df, [], sort).select("product_id", "rank").collect()))
        assert at(narrow) == at(groups)


def test_coverage_asks_for_held_tokens_of_texts_that_pass(spark):
    texts = spark.sql("select * from values ('sweatshirt'), ('sweatshirt myhoodies'), ('hoodie'), ('other') t(search_text)")
    queries = spark.sql("select 'q' query_id, 'hoodie' query")
    found = search.coverage(queries, search.distinct_texts(texts))
    assert "RepartitionByExpression" in _written_out(found)
    assert sorted(round(r.coverage, 3) for r in found.collect()) == [0.7, 1.0]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "TASK_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("listing_id"), F.col("id").alias("position"))
    stream.write_initial(rows, str(tmp_path), 2)
    assert len(list(tmp_path.glob("data/version=-1/bucket=0/*.parquet"))) > 1
    assert stream.read_current(spark, str(tmp_path)).count() == 1000


def test_a_batch_rewrites_some_buckets_after_others(spark, monkeypatch, tmp_path):
    from pricemesh.streaming import upsert as stream

    known = spark.range(60).select(F.concat(F.lit("k"), "id").alias("listing_id"), F.col("id").alias("position"), F.lit(9.0).alias("price"), F.lit(10.0).alias("mrp"), F.lit(10.0).alias("discount_percentage"))
    fresh = spark.range(30, 90).select(F.concat(F.lit("k"), "id").alias("listing_id"), F.col("id").alias("position"), F.lit(5.0).alias("price"), F.lit(10.0).alias("mrp"))
    monkeypatch.setattr(stream, "PASS_ROWS", 50)
    written = []
    monkeypatch.setattr(stream, "upsert", lambda a, b: written.append(1) or ingest.upsert(a, b))
    stream.write_initial(known, str(tmp_path), 4)
    stream.upsert_batch(fresh, 0, str(tmp_path), 4)
    got = stream.read_current(spark, str(tmp_path)).select(*known.columns)
    assert len(written) == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.upsert(known, fresh).collect()))


def test_similar_products_are_ranked_once_a_class(spark, monkeypatch):
    """Classes 1 (three copies apart) and 9 (one product): each copy is similar to the other two and to 9."""
    from pricemesh.operators import explain

    products = spark.sql("select * from values (1L, 1L, 1L), (4L, 1L, 1L), (6L, 1L, 1L), (9L, 9L, 2L) t(product_id, class_id, listing_count)")
    similar = spark.sql("select *, array() reasons from values (1L, 1L, 0.8D, 80L), (1L, 9L, 0.8D, 80L), (9L, 1L, 0.8D, 80L) t(class_id, other_class, combined_score, similarity)")
    ranked, rank = [], explain.rank_within
    monkeypatch.setattr(explain, "rank_within", lambda df, *a: ranked.append(df.count()) or rank(df, *a))
    got = explain.similar_of(products.select("product_id", "class_id"), products, similar)
    want = [(1, 4, 1), (1, 6, 2), (1, 9, 3), (4, 1, 1), (4, 6, 2), (4, 9, 3), (6, 1, 1), (6, 4, 2), (6, 9, 3), (9, 1, 1), (9, 4, 2), (9, 6, 3)]
    assert sorted((r.product_id, r.other_product, r.place) for r in got.collect()) == want
    assert ranked == [7]


def test_search_text_is_read_once_for_equal_listings(spark):
    """Equal statements are one row below the rules; missing ones and the order of repeated attributes count."""
    from pricemesh.functions import attributes, text

    rows = spark.sql(
        "select * from values ('Red Bolt 5 ml', '', 'Acme', 'Shoes', map('Colour', 'Red', 'color', 'Blue')), ('Red Bolt 5 ml', '', 'Acme', 'Shoes', map('color', 'Blue', 'Colour', 'Red')),"
        " ('Red Bolt 5 ml', null, null, null, null), (null, '', 'Acme', 'Shoes', map('size', '3')) t(title, description, brand, category, product_attributes)"
    ).crossJoin(spark.range(5).withColumnRenamed("id", "listing_id"))
    want = attributes.with_attributes(rows).select("listing_id", text.search_text(F.col("title"), F.col("attributes")).alias("t"))
    got = search.with_search_text(rows)
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(got.select("listing_id", "search_text")) == key(want)
    # The rules stand above the aggregate that makes statements distinct.
    plan = _written_out(got)
    assert plan.index("regexp_replace") < plan.index("Aggregate")
