"""Bloom filters from a 32-bit hash column: k positions by double hashing, one bit each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..model import free_name

MASK = 0xFFFFFFFF


def bloom_shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) for n keys at false-positive rate p."""
    n = max(n, 1)
    per_key = math.ceil(-n * math.log(p) / math.log(2) ** 2 / n)
    k = min(30, max(1, int(per_key * 0.69)))
    return (max(n * per_key, 64) + 7) // 8 * 8, k


def bloom_positions(h: Column, bits: int, k: int) -> Column:
    turn = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(MASK))
    return F.array(*[F.pmod((h + F.lit(i).cast("long") * turn).bitwiseAND(F.lit(MASK)), F.lit(bits).cast("long")) for i in range(k)])


def bloom_build(df: DataFrame, h: str, bits: int, k: int) -> DataFrame:
    """The set bits, one row each: (bit). Partial aggregation bounds every task to `bits` rows."""
    return df.select(F.explode(bloom_positions(F.col(h), bits, k)).alias("bit")).distinct()


def bloom_bitmap(bits_df: DataFrame) -> DataFrame:
    """Packed form: (bucket, bitmap BINARY), 32,768 bits a bucket."""
    return bits_df.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bitmap"))


def bloom_unpack(bitmap_df: DataFrame) -> DataFrame:
    """The set bits, one row each, of the packed form."""
    octet = lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i + 1, 1)), 16, 10).cast("int")
    bits = bitmap_df.select("bucket", F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("bitmap") - 1), octet)).alias("at", "byte")).filter("byte <> 0")
    each = bits.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).filter("getbit(byte, i) = 1")
    return each.select(((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("i")).alias("bit"))


def bloom_probe(probes: DataFrame, h: str, bits_df: DataFrame, bits: int, k: int) -> DataFrame:
    """Adds may_contain: whether all positions of the row's hash are set. Rows are told apart by their hash."""
    own = free_name("hash", probes.columns)
    asked = probes.select(F.col(h).alias(own)).distinct().select(own, F.explode(F.array_distinct(bloom_positions(F.col(own), bits, k))).alias("bit"))
    hit = asked.join(bits_df.select("bit", F.lit(1).alias("set")), "bit", "left").groupBy(own).agg((F.count("set") == F.count(F.lit(1))).alias("found"))
    return probes.join(hit, probes[h] == hit[own], "left").select(*(probes[c] for c in probes.columns if c != "may_contain"), F.coalesce("found", F.lit(False)).alias("may_contain"))
