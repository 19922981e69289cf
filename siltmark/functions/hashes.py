"""Hashes as column expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits: the offset basis in halves of 32 bits; the prime is 2**40 + 435.
_BASIS = (0xCBF29CE4, 0x84222325)
_PRIME_LOW = 435
_HALF = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a text, as a signed 64-bit number; null for null.

    The product is formed in halves of 32 bits, so no step leaves 64 bits, whatever the session says of overflow.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    length = F.octet_length(text)
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    half = F.lit(_HALF).cast("long")
    start = F.struct(F.lit(_BASIS[0]).cast("long").alias("high"), F.lit(_BASIS[1]).cast("long").alias("low"))

    def step(held: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        low = held["low"].bitwiseXOR(byte)
        product = low * F.lit(_PRIME_LOW)
        high = held["high"] * F.lit(_PRIME_LOW) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    out = F.aggregate(places, start, step, lambda held: F.shiftleft(held["high"], 32).bitwiseOR(held["low"]))
    return F.when(text.isNotNull(), out)
