"""Substring search over many texts for a table of needles, by a written index of three-letter grams.

Every place of a text gives one gram: its letter and the two after it, fewer at
the end.  A needle of three letters and more is looked up by its rarest gram; a
shorter one by all grams that begin with it, so no further postings are needed.
What is found is confirmed on the text.  Rows are added as another part, without
rewriting those that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # folders of postings; only those of the grams looked up are read
LETTERS = 3


def _grams(text: Column) -> Column:
    """The gram at every place; letters are code points.  Shifted copies are zipped, so the work is linear in the text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    out = letters
    for n in range(1, LETTERS):
        out = F.zip_with(out, F.slice(letters, n + 1, F.size(letters)), lambda g, c: F.concat(g, F.coalesce(c, F.lit(""))))
    return out


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, id_col: str, text_col: str, folder: str, part: int = 0) -> None:
    """Postings of the rows as one part of the index in ``folder``; a part that is written again is replaced.

    Null and empty texts have none.  An id may come again in a later part, with
    another text: the index then finds it under both and the search confirms.
    """
    letters = F.lower(F.col(text_col))
    postings = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(_grams(letters))).alias("gram"))
    path = f"{folder}/postings/part={part}"
    # Dealt by folder, with large folders split by measured size: a range would take all grams a first time to find its bounds.
    placed = postings.withColumn("bucket", _bucket(F.col("gram"))).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)
    counted = rows.sparkSession.read.schema(placed.schema).parquet(path).groupBy("gram").agg(F.count("*").alias("n"))
    counted.write.mode("overwrite").parquet(f"{folder}/counts/part={part}")


def find_substrings(needles: DataFrame, needle_col: str, texts: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """(needle, id) of all texts that contain a needle, whatever the case; each pair once per row of ``texts``.

    Needles are trimmed, lowered and counted once; empty and null ones find
    nothing.  ``texts`` holds the rows of the index as they are now.
    """
    spark: SparkSession = texts.sparkSession
    trimmed = F.regexp_replace(F.lower(F.col(needle_col)), r"(?U)^\s+|\s+$", "")
    asked = needles.select(trimmed.alias("needle")).filter("needle <> ''").distinct()
    # One line per gram of the alphabet.
    counts = spark.read.schema("gram string, n long").parquet(f"{folder}/counts").groupBy("gram").agg(F.sum("n").alias("n"))
    long = asked.filter(F.char_length("needle") >= LETTERS).select(
        "needle", F.explode(F.filter(_grams(F.col("needle")), lambda g: F.char_length(g) == LETTERS)).alias("gram")
    )
    rarest = long.join(counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    probes = rarest
    for n in range(1, LETTERS):
        short = asked.filter(F.char_length("needle") == n)
        probes = probes.unionByName(short.join(counts, F.substring("gram", 1, n) == F.col("needle")).select("needle", "gram"))
    probes = probes.withColumn("bucket", _bucket(F.col("gram")))
    kind = texts.schema[id_col].dataType.simpleString()
    postings = spark.read.schema(f"gram string, id {kind}, bucket int, part int").parquet(f"{folder}/postings")
    found = postings.join(probes, ["bucket", "gram"]).select("needle", "id").distinct()
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_text"))
    return found.join(rows, "id").filter(F.contains("_text", "needle")).select("needle", "id")
