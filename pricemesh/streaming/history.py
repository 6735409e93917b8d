"""Search history as a stream: repeats dropped, then appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def clean_history(searches: DataFrame, slot: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Trimmed searches; the same search counts once per time slot.

    The slot is part of the key, so the outcome does not depend on how the
    stream is cut into batches.
    """
    return (
        searches.withColumn("query", F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))
        .filter("query <> ''")
        .withColumn("slot", F.window("created_at", slot)["start"])
        .withWatermark("created_at", late)
        .dropDuplicatesWithinWatermark(["query", "pincode", "slot"])
    )


def start_history(searches: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        clean_history(searches)
        .writeStream.format("parquet")
        .option("path", f"{folder}/history")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
