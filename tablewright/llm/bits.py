"""Membership bits of long hashes: built by a distributed bitmap aggregate, of bounded size, sent to all tasks.

A hash that was put in is always found; others are found by chance, the more the fuller the bits are. So bits may only
thin out rows whose exact test comes later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member, and the bounds of a table of bits (2**29 bits are 64 MB).
BITS_EACH = 16
MIN_BITS = 1 << 16
MAX_BITS = 1 << 29


def bits_of(hashes: DataFrame, column: str, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits (uint8, a power of two of them) of the low digits of each hash (long) in the column.

    Above max_bits / BITS_EACH members the table does not grow and lets more other hashes through.
    """
    members, size = hashes.count(), MIN_BITS
    while size < min(max_bits, BITS_EACH * members):
        size *= 2
    cell = F.col(column).bitwiseAND(F.lit(size - 1).cast("long")) + 1  # positions of Spark's bitmaps begin at 1
    parts = (hashes.select(F.bitmap_bucket_number(cell).alias("part"), F.bitmap_bit_position(cell).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow())  # size / 8 bytes at most
    bits, width = np.zeros(size // 8, dtype=np.uint8), 4096
    for part, block in zip(parts.column("part").to_pylist(), parts.column("bits")):
        at = (part - 1) * width
        found = np.frombuffer(block.as_buffer(), dtype=np.uint8)
        bits[at:at + width] = found[:len(bits) - at]
    return bits


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each hash (uint64) whose bit is set."""
    cell = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
