"""Similarity of two 64-bit perceptual hashes given as 16 hex digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Any function of two hash columns giving a score in [0, 1] can take its place.
ImageSimilarity = Callable[[Column, Column], Column]


def hash_half(h: Column, half: int) -> Column:
    """High (0) or low (1) 32 bits; two halves because 64 bits overflow BIGINT."""
    padded = F.lpad(h, 16, "0")
    return F.conv(F.substring(padded, 1 + 8 * half, 8), 16, 10).cast("bigint")


def hash_similarity(a: Column, b: Column) -> Column:
    bits = sum(
        (F.bit_count(hash_half(a, h).bitwiseXOR(hash_half(b, h))) for h in (1,)),
        F.bit_count(hash_half(a, 0).bitwiseXOR(hash_half(b, 0))),
    )
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(known, F.round(1 - bits / 64, 4)).otherwise(0.5)
