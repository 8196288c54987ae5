"""Joins on hot keys and filters of proven size.

``salted_join`` spreads the few keys that hold a large share of one side over
many tasks; ``key_filter`` turns any number of hashes into a bit set that never
exceeds a stated size and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of a side's rows on, so there are at most 1 / HOT_SHARE hot keys; fewer than HOT_LEAST rows are never hot.
HOT_SHARE, HOT_LEAST = 0.001, 20_000
WAYS = 16


def hot_keys(df: DataFrame, key: str, total: int, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list:
    """Keys that hold at least ``share`` of the ``total`` rows (and ``least`` of them): at most 1 / share values, null not among them.

    One aggregate with a map-side part, and none where there are too few rows;
    only the hot keys come to the driver.
    """
    floor = max(least, int(np.ceil(total * share)))
    if total < floor:
        return []
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in per.filter(F.col("__n") >= floor).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: str, hot: Sequence, spread: Sequence[str], how: str = "inner", ways: int = WAYS) -> DataFrame:
    """Equi-join on one column in which the rows of hot left keys are dealt out to ``ways`` tasks by the hash of
    the ``spread`` columns, and the right side's rows of those keys are repeated as often. ``how``: inner, left or
    left_semi. Same rows as a plain join."""
    if not hot:
        return left.join(right, on, how)
    is_hot = F.col(on).isin(list(hot))
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(ways))).otherwise(F.lit(0).cast("long"))
    copies = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", F.explode(copies)), [on, "__salt"], how).drop("__salt")


def lookup_join(left: DataFrame, table: DataFrame, on: str, spread: Sequence[str], how: str = "left", most: int = 100_000) -> DataFrame:
    """Equi-join with a table of one row per key: broadcast if it is counted to have at most ``most`` rows, else salted.
    Starts a job for the count."""
    if table.count() <= most:
        return left.join(F.broadcast(table), on, how)
    return salted_join(left, table, on, hot_keys(left, on, left.count()), spread, how)


#: Where in a hash the probes of a bit set begin.
_PROBES = (0, 17, 34)


def filter_bits(n: int, most: int = 30) -> int:
    """log2 of the size of a bit set for ``n`` hashes: 16 to 32 bits each, which let at most one in 200 others through, and at most 2**most bits (2**30: 128 MB)."""
    return int(min(most, max(16, np.ceil(np.log2(16.0 * max(n, 1))))))


def key_filter(df: DataFrame, key: Column, log2_bits: int) -> np.ndarray:
    """64-bit words of a bit set of ``2**log2_bits`` bits in which three bits of every 64-bit hash are set.

    The words are made by an aggregate, so what comes to the driver is at most
    the bit set itself, however many hashes there are. Never misses a hash that
    was put in; a full set only lets more through.
    """
    low = df.select(F.explode(F.array(*[F.shiftrightunsigned(key, p).bitwiseAND(F.lit((1 << log2_bits) - 1)) for p in _PROBES])).alias("x"))
    words = low.select(F.shiftright("x", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int")).alias("w"))
    got = words.groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[got.column("i").to_numpy()] = got.column("w").to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (uint64) hash may be in the set."""
    mask, out = np.uint64(len(bits) * 64 - 1), np.zeros(len(hashes), bool)
    live = np.arange(len(hashes))
    for p in _PROBES:
        low = (hashes[live] >> np.uint64(p)) & mask
        live = live[(bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0]
    out[live] = True
    return out
