"""Table access, shared scratch tables and text batches for the operators of this folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pricemesh.session import shared_folder


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh URI in the folder that driver and executors share."""
    folder = re.sub(r"^file:/+", "file:///", shared_folder(spark).rstrip("/"))
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``most`` bytes of text; one row is never cut."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + c)`` of all pairs."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = [np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], dtype=np.uint64) for seed in (1, 2)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of True."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1 if len(mask) else np.empty(0, dtype=np.int64)
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    if len(mask) and mask[-1]:
        edge = np.concatenate([edge, [len(mask)]])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit polynomial hash of the bytes of each span; spans are in order and do not overlap."""
    lengths = end - begin
    if not len(lengths):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max()), MULTIPLIER))])
        inside = np.arange(int(lengths.sum()), dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        # Where the spans lie back to back, as words without their blanks, positions are simple sums.
        at = inside - np.repeat(first, lengths)
        terms = _BYTE_KEYS[which][data[at + np.repeat(begin, lengths)]] * powers[at]
        return np.add.reduceat(terms, first) * MULTIPLIER + lengths.astype(np.uint64)
