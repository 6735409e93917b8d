"""Keyword search for a whole table of queries at once.

Texts that read the same are searched once.  The commonest words of a query,
up to half the coverage floor by weight, are kept out of the lookup: a text
must earn the other half from the rarer words, which are matched by joins.  A
word found in a third of all texts is then a join key only for queries in which
it carries real weight.  The few texts that pass are checked for the common
words too, so the result is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.config import SearchConfig
from pricemesh.functions.attributes import with_attributes
from pricemesh.functions.text import digest, search_text, tokens
from pricemesh.operators.idf import corpus_idf, micros
from pricemesh.session import cut_lineage


def with_search_text(listings: DataFrame) -> DataFrame:
    """Add ``search_text``.  Listings that state the same are read by the text rules once, however many offers they are."""
    # Entries keep the order of the map, in which a repeated attribute counts.
    stated = {k: F.col(k) for k in ("title", "description", "brand", "category")} | {"_entries": F.map_entries("product_attributes")}
    texts = listings.select(*[v.alias(k) for k, v in stated.items()]).distinct()
    read = with_attributes(texts.withColumn("product_attributes", F.map_from_entries("_entries")))
    told = read.select(*[F.col(k).alias(f"_of_{k}") for k in stated], search_text(F.col("title"), F.col("attributes")).alias("search_text"))
    same = F.lit(True)
    for k, v in stated.items():
        same = same & v.eqNullSafe(F.col(f"_of_{k}"))
    return listings.join(told, same).drop(*[f"_of_{k}" for k in stated])


def distinct_texts(docs: DataFrame, text: str = "search_text") -> DataFrame:
    """(text_id, words, copies): one row per distinct search text."""
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    return docs.groupBy(text).agg(F.count("*").alias("copies")).select(
        digest(F.col(text)).alias("text_id"), words.alias("words"), "copies"
    )


def query_tokens(queries: DataFrame, idf: DataFrame, cfg: SearchConfig) -> DataFrame:
    """One row per distinct (query, token): weight, repeats and whether it can be left out of the lookup.

    ``droppable`` tokens are the commonest ones, together below half the floor.
    """
    said = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    counted = said.groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighed = counted.join(idf.select("token", "idf_micros"), "token", "left").withColumn(
        "idf_micros", F.coalesce("idf_micros", micros(F.lit(cfg.unseen_idf)))
    )
    weight = F.col("times") * F.col("idf_micros")
    # A query is as long as its own text, so its window stays small.
    of_query = Window.partitionBy("query_id")
    lightest = of_query.orderBy("idf_micros", "token").rowsBetween(Window.unboundedPreceding, 0)
    return (
        weighed.withColumn("total", F.sum(weight).over(of_query))
        .withColumn("_light", F.sum(weight).over(lightest))
        .withColumn("droppable", F.col("_light") < F.col("total") * (cfg.min_coverage / 2))
        .drop("_light")
    )


def _synonyms(token: Column) -> Column:
    table = F.create_map(
        *[x for k, v in vocab.SEARCH_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]
    )
    return F.coalesce(F.try_element_at(table, token), F.array().cast("array<string>"))


def _grams(word: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(n))
    )


def query_words(vocabulary: DataFrame, asked: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(token, word, tenths, holds): words that contain the token or are its synonym, and their credit.

    Containment is an equi-join on the token's first one to three characters
    against the words' character n-grams, then a check.
    """
    token, word = F.col("token"), F.col("word")
    distinct = asked.select("token").distinct()
    keyed = distinct.withColumn("gram", F.substring("token", 1, 3))
    grams = F.array_distinct(F.concat(*[_grams(word, n) for n in (1, 2, 3)]))
    starts = (F.length(token) >= cfg.prefix_min_chars) & word.startswith(token)
    inside = (
        vocabulary.select("word", F.explode(grams).alias("gram"))
        .join(keyed, "gram")
        .filter(F.contains(word, token))
        .select(
            "token",
            "word",
            F.when(word == token, 10).when(starts, round(cfg.prefix_credit * 10)).otherwise(0).alias("tenths"),
            F.lit(True).alias("holds"),
        )
    )
    synonyms = distinct.select(
        "token",
        F.explode(_synonyms(token)).alias("word"),
        F.lit(round(cfg.synonym_credit * 10)).alias("tenths"),
        F.lit(False).alias("holds"),
    )
    return inside.unionByName(synonyms)


def coverage(queries: DataFrame, texts: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, text_id, coverage) of all texts at or above the floor.

    ``queries`` holds (query_id, query); ``texts`` comes from ``distinct_texts``.
    """
    c = F.col
    # Read for the weights, the vocabulary, the postings and the check.  Texts and query tokens go
    # by numbers, which the written rows fix: they are narrower than digests and words.
    texts = cut_lineage(texts).withColumn("_text", F.monotonically_increasing_id())
    idf = corpus_idf(texts, "words", "copies")
    asked = cut_lineage(query_tokens(queries, idf, cfg)).withColumn("_slot", F.monotonically_increasing_id())
    leading = asked.filter(~c("droppable"))
    vocabulary = idf.select(c("token").alias("word"))
    # Words without credit earn nothing; whether one holds a token is asked of the few texts that pass.
    lookup = leading.join(query_words(vocabulary, leading, cfg).filter("tenths > 0"), "token").select(
        "query_id", "_slot", (c("times") * c("idf_micros")).alias("weight"), "word", "tenths", "holds"
    )
    postings = texts.select("_text", F.explode("words").alias("word"))
    # Dealt by query and text once, which serves both sums.
    matched = lookup.join(postings, "word").drop("word").repartition("query_id", "_text")
    per_token = matched.groupBy("query_id", "_text", "_slot", "weight").agg(F.max("tenths").alias("tenths"), F.max("holds").alias("holds"))
    earned = per_token.groupBy("query_id", "_text").agg(
        F.sum(c("tenths") * c("weight")).alias("earned"), F.max("holds").alias("holds")
    )

    # A query has as many entries here as it has words.
    light = F.when(
        c("droppable"), F.struct("token", (c("times") * c("idf_micros")).alias("weight"), _synonyms(c("token")).alias("synonyms"))
    )
    whole = asked.groupBy("query_id").agg(
        F.collect_list(light).alias("light"),
        F.collect_list("token").alias("tokens"),
        F.max("total").alias("total"),
        F.sum(F.when(c("droppable"), c("times") * c("idf_micros")).otherwise(0)).alias("light_total"),
    )
    floor = c("total") * 10 * cfg.min_coverage
    possible = earned.join(whole, "query_id").filter(c("earned") + 10 * c("light_total") >= floor - 1)
    met = possible.join(texts.select("_text", "text_id", "words"), "_text")

    def credit(t: Column) -> Column:
        starts = F.exists(c("words"), lambda w: w.startswith(t["token"]))
        tenths = (
            F.when(F.array_contains(c("words"), t["token"]), 10)
            .when(F.arrays_overlap(c("words"), t["synonyms"]), round(cfg.synonym_credit * 10))
            .when((F.length(t["token"]) >= cfg.prefix_min_chars) & starts, round(cfg.prefix_credit * 10))
            .otherwise(0)
        )
        return tenths * t["weight"]

    more = F.aggregate(F.transform("light", credit), F.lit(0).cast("bigint"), lambda s, x: s + x)
    # A synonym alone never makes a text a candidate: some token must occur in it.
    found = c("holds") | F.exists("tokens", lambda t: F.exists(c("words"), lambda w: F.contains(w, t)))
    scored = met.select(
        "query_id",
        "text_id",
        ((c("earned") + more).cast("double") / (c("total") * 10)).alias("coverage"),
        found.alias("found"),
    )
    return scored.filter((c("coverage") >= cfg.min_coverage) & c("found")).drop("found")


def listing_relevance(hits: DataFrame, listings: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Listings found by each query, with their relevance."""
    keyed = listings.withColumn("text_id", digest(F.col("search_text")))
    bonus = cfg.review_bonus * F.least(F.lit(1.0), F.col("review_count") / cfg.review_cap)
    return (
        hits.join(keyed, "text_id")
        .withColumn("relevance", F.round(F.col("coverage") + bonus, 4))
        .drop("text_id", "coverage")
    )
