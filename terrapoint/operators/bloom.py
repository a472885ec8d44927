"""Exact-key Bloom filter over rows. It answers membership of keys that were inserted, not of regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.types import ConfigError


def positions(key: list[Column], bits: int, hashes: int) -> Column:
    """The `hashes` bit numbers of a key. Doubles get + 0.0 first, so that -0.0 and 0.0 are one key."""
    h1 = F.pmod(F.xxhash64(F.lit(1), *key), F.lit(bits))
    h2 = F.pmod(F.xxhash64(F.lit(2), *key), F.lit(bits)).bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def build(df: DataFrame, key: list[Column], size_bytes: int = 131_072, hashes: int = 7) -> DataFrame:
    """word and bits (64-bit words that are not zero): size_bytes / 8 rows at most, so the filter may be broadcast."""
    if size_bytes < 8 or hashes < 1:
        raise ConfigError("a filter needs 8 bytes and one hash at least")
    bits = size_bytes // 8 * 64
    at = df.select(F.explode(positions(key, bits, hashes)).alias("bit"))
    return at.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))


def check(df: DataFrame, key: list[Column], words: DataFrame, size_bytes: int = 131_072, hashes: int = 7) -> DataFrame:
    """df with maybe: false where the key was certainly never inserted."""
    bits = size_bytes // 8 * 64
    # All words in one array, found by their place: a scalar subquery, whose one value is bound by the filter's size.
    every = df.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = words.select("word", "bits").unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("w")).scalar()
    h1 = F.pmod(F.xxhash64(F.lit(1), *key), F.lit(bits))
    h2 = F.pmod(F.xxhash64(F.lit(2), *key), F.lit(bits)).bitwiseOR(F.lit(1).cast("long"))
    at = [F.pmod(h1 + i * h2, F.lit(bits)) for i in range(hashes)]
    # getbit() of a word that is there: every place is under bits.
    return df.withColumn("maybe", reduce(Column.__and__, [F.getbit(F.get(held, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1 for b in at]))
