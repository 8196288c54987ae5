"""Invariants as queries: one row per check, with the number of offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_offenders(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, offenders, ok) for row-level conditions that must hold; null counts as a breach. One pass."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("offenders")) for i, k in enumerate(checks)])).alias("x")
    return agg.select(rows).select("x.check", "x.offenders", (F.col("x.offenders") == 0).alias("ok"))


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """(check, offenders, ok): number of keys that occur more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dup.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check"), "offenders", (F.col("offenders") == 0).alias("ok"))


def disjoint_groups(df: DataFrame, group: str, part: str, name: str = "disjoint") -> DataFrame:
    """(check, offenders, ok): number of groups that stand in more than one part."""
    bad = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(part).alias("n")).filter("n > 1")
    return bad.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check"), "offenders", (F.col("offenders") == 0).alias("ok"))


def monotone_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "monotone") -> DataFrame:
    """(check, offenders, ok): rows whose value is below that of the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    bad = df.withColumn("__p", F.lag(value).over(w)).filter(F.col(value) < F.col("__p"))
    return bad.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check"), "offenders", (F.col("offenders") == 0).alias("ok"))


def all_checks(*parts: DataFrame) -> DataFrame:
    """The union of check tables."""
    return reduce(lambda a, b: a.unionByName(b), parts)
