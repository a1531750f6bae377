"""Rows whose id may be among some ids, without a shuffle: a Bloom filter of bounded size as a broadcast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that a filter has at most; bits for each id.
FILTER_WORDS, FILTER_BITS = 1 << 20, 16


def maybe(rows: DataFrame, key: str, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """Add ``name``: false only where ``key`` is not among the ``n`` ids of ``wanted`` (its only column). With
    more ids than FILTER_WORDS have room for it is true more often, which a later join makes good."""
    words = min(FILTER_WORDS, 1 << max(0, n * FILTER_BITS // 64).bit_length())
    word, bit = (lambda c: F.pmod(F.xxhash64(c), F.lit(words))), (lambda c: F.pmod(F.xxhash64(F.lit("bit"), F.col(c)), F.lit(64)).cast("int"))
    own = wanted.columns[0]
    bits = wanted.select(word(own).alias(f"{name}_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(own)).alias(f"{name}_bit"))
    table = bits.groupBy(f"{name}_word").agg(F.bit_or(f"{name}_bit").alias(f"{name}_bits"))
    joined = rows.withColumn(f"{name}_word", word(key)).join(F.broadcast(table), f"{name}_word", "left")
    hit = F.coalesce(F.getbit(f"{name}_bits", bit(key)) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop(f"{name}_word", f"{name}_bits")
