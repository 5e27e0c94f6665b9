"""Filters of fixed size over 64-bit keys, built by Spark and tested in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A filter is 16 MB, whatever the table; with more keys it lets more through, never less.
BITS = 1 << 27
_BUCKET = 1 << 15  # bits of one row of bitmap_construct_agg


def filter_of(keys: DataFrame) -> np.ndarray:
    """The bitmap of a table of ``key`` (long)."""
    # numbers from 1, so that buckets are numbered from 1 without a gap
    place = F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1
    rows = (
        keys.select(place.alias("at"))
        .groupBy(F.call_function("bitmap_bucket_number", F.col("at")).alias("bucket"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bits"))
    )
    out = np.zeros((BITS // _BUCKET, _BUCKET // 8), np.uint8)
    for bucket, bits in rows.collect():  # 4096 rows of 4096 bytes at the most
        out[bucket - 1] = np.frombuffer(bytes(bits), np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys (64-bit, signed or not) may be in the table; those that are always do."""
    at = key.view(np.int64) & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
