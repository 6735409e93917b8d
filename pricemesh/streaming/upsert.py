"""Streaming upsert of feed rows into a listing table.

Plain parquet has no merge, so the table is kept in hash buckets of the listing
id and a micro-batch rewrites only the buckets it touches.  Each batch writes a
new version of those buckets and then adds a manifest naming, per bucket, the
version in force; a batch that is run again after a failure finds its manifest
and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricemesh.operators.ingest import upsert
from pricemesh.session import release, spread

TASK_ROWS = 250_000  # most rows a writing task is meant to sort: a large bucket is several files
PASS_ROWS = 4_000_000  # rows of table and batch whose buckets are rewritten at a time

VERSIONS = "bucket int, version bigint"


def bucket_of(listing_id: str, buckets: int):
    return F.pmod(F.xxhash64(listing_id), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(VERSIONS).parquet(f"{folder}/manifest") if fs.exists(path) else None


def write_initial(listings: DataFrame, folder: str, buckets: int) -> None:
    """Lay out a listing table as version -1 of every bucket."""
    spark = listings.sparkSession
    placed = spread(listings, "listing_id", rows_per_task=TASK_ROWS)
    release(spark)   # the shuffles of the count
    placed.withColumn("bucket", bucket_of("listing_id", buckets)).withColumn("version", F.lit(-1)).write.mode("overwrite").option("compression", "zstd").partitionBy("version", "bucket").parquet(f"{folder}/data")
    spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(-1).cast("bigint").alias("version")).write.mode(
        "overwrite"
    ).parquet(f"{folder}/manifest")
    release(spark)


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The table as of the last finished batch."""
    versions = _manifests(spark, folder).groupBy("bucket").agg(F.max("version").alias("version"))
    data = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return data.join(versions, ["bucket", "version"], "left_semi").drop("bucket", "version")


def upsert_batch(batch: DataFrame, batch_id: int, folder: str, buckets: int) -> None:
    spark = batch.sparkSession
    manifests = _manifests(spark, folder)
    if not manifests.filter(F.col("version") >= batch_id).isEmpty():
        return
    fresh = batch.withColumn("bucket", bucket_of("listing_id", buckets))
    touched = fresh.select("bucket").distinct()
    current = read_current(spark, folder).withColumn("bucket", bucket_of("listing_id", buckets))
    known = current.join(touched, "bucket", "left_semi")
    rows = batch.count() + current.count()
    # Some buckets after others: between the steps lie the rows of a few buckets.
    passes = max(1, min(buckets, -(-rows // PASS_ROWS)))
    tasks = max(1, -(-rows // (passes * TASK_ROWS)))
    for turn in range(passes):
        now = F.col("bucket") % passes == turn
        # Both sides are dealt alike by listing, over tasks as their rows need; the join needs no further shuffle.
        merged = upsert(*(side.filter(now).drop("bucket").repartition(tasks, "listing_id") for side in (known, fresh)))
        merged.withColumn("bucket", bucket_of("listing_id", buckets)).withColumn("version", F.lit(batch_id)).write.mode(
            "append"
        ).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("version", "bucket").parquet(f"{folder}/data")
        del merged
        release(spark)
    touched.select("bucket", F.lit(batch_id).cast("bigint").alias("version")).write.mode("append").parquet(
        f"{folder}/manifest"
    )


def start_upsert(feed: DataFrame, folder: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    return (
        feed.writeStream.foreachBatch(lambda df, i: upsert_batch(df, i, folder, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
