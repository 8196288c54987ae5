"""Ordered computations over groups that may be too large for one task.

``lag``, ``lead`` and running sums need each group in order. A window over the
group alone sends a group that holds a third of all rows to one task. The
functions here take a second key, the *chunk*: consecutive pieces of the group
(for example stretches of time) whose numbers rise with the order. The window
runs inside (group, chunk); one summary row per chunk then carries the state
over chunk borders. The summary side is as small as the number of chunks and
is joined back on the partitioning that the rows already have.

Nulls in ``group`` form one group of their own (as in a window). Ties in
``order`` are resolved by whatever else ``order`` lists; callers give a total
order. Empty input gives empty output with the full schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    cond = None
    s = summary.select(*[F.col(k).alias(f"__s_{k}") for k in keys], *cols)
    for k in keys:
        one = df[k].eqNullSafe(s[f"__s_{k}"])
        cond = one if cond is None else cond & one
    return df.join(s, cond, "left").drop(*[f"__s_{k}" for k in keys])


def running_sum(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within ``group``, null counted as 0."""
    keys = [*group, chunk]
    value = F.coalesce(value, F.lit(0))
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("__local", F.sum(value).over(inner))
    total = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    summary = total.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    return _join_back(local, summary, keys, ["__base"]).withColumn(out, F.col("__local") + F.col("__base")).drop("__local", "__base")


def next_value(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``value`` of the following row in ``order`` within ``group``; null after the last row."""
    keys = [*group, chunk]
    inner = W.partitionBy(*keys).orderBy(*order)
    held = F.struct(value.alias("v"))
    local = df.withColumn("__next", F.lead(held).over(inner))
    first = df.groupBy(*keys).agg(F.min_by(held, F.struct(*order)).alias("__first"))
    after = W.partitionBy(*group).orderBy(chunk)
    summary = first.select(*keys, F.lead("__first").over(after).alias("__after"))
    return _join_back(local, summary, keys, ["__after"]).withColumn(out, F.coalesce("__next", "__after")["v"]).drop("__next", "__after")
