"""A Bloom filter as rows, and a semi-join that uses one and then joins exactly.

The filter is blocked: all bits of a key lie in one block of 4 KB, so that a row is tested by one
lookup in one broadcast table whatever the number of hashes. Its size follows from the expected
number of keys and the error rate, up to MOST_BITS.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27  # 16 MB: beyond it the error rate grows, not the broadcast


def shape(expected: int, error: float) -> tuple[int, int]:
    """(bits, hashes)."""
    n = max(1, expected)
    bits = max(8, math.ceil(-n * math.log(error) / math.log(2) ** 2))
    return min(MOST_BITS, bits), min(30, max(1, round(bits / n * math.log(2))))


BLOCK = 32_768  # bits


def _block(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(-(-bits // BLOCK)))


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    """Places of a key within its block, by double hashing."""
    size = min(bits, BLOCK)
    one, two = F.pmod(F.xxhash64(key), F.lit(size)), F.pmod(F.xxhash64(F.lit(1), key), F.lit(size))
    return [F.pmod(one + F.lit(i) * two, F.lit(size)) for i in range(hashes)]


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(block, bitmap)."""
    spots = keys.select(_block(F.col(key), bits).alias("block"), F.explode(F.array(*_places(F.col(key), bits, hashes))).alias("p"))
    return spots.groupBy("block").agg(F.bitmap_construct_agg("p").alias("bitmap"))


def _bit_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (place % 8).cast("int") + 1)) != 0


def maybe(rows: DataFrame, key: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows whose key the filter may hold: one broadcast lookup, at most MOST_BITS in all."""
    names = rows.columns
    met = rows.withColumn("_block", _block(F.col(key), bits)).join(F.broadcast(filter_), F.col("_block") == F.col("block"))
    for place in _places(F.col(key), bits, hashes):
        met = met.where(_bit_set(F.col("bitmap"), place))
    return met.select(names)


def semi_join(rows: DataFrame, keys: DataFrame, key: str, expected: int, error: float = 0.01) -> DataFrame:
    """rows whose key is among keys: prefiltered, then exact."""
    bits, hashes = shape(expected, error)
    return maybe(rows, key, build(keys, key, bits, hashes), bits, hashes).join(keys.select(key), key, "left_semi")
