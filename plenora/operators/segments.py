"""Preparation of timed speech spans shared by the sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str, keep: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``version``, with the ``keep`` columns.

    The greatest struct (version, kept columns) is an aggregate with a map-side
    part, so a key delivered a million times shrinks before the shuffle.
    Rows with a null key are left out; a null version is older than any other;
    rows equal in version are settled by the kept columns, the greatest value
    first, so the choice does not depend on partitioning. Columns of the input
    other than those named are dropped.
    """
    top = F.max(F.struct(F.col(version), *[F.col(c) for c in keep])).alias("__top")
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(top)
    return one.select(key, *[F.col("__top")[c].alias(c) for c in keep])


def usable_spans(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Usable rows of a segments table: one per filename (latest delivery), with session, start < end.

    Null or NaN times, reversed or empty spans and rows without session or
    filename are left out. Output: filename, session, start, end, *extra.
    """
    keep = ["session", "start", "end", *extra]
    one = latest_rows(df, "filename", "ingested_at", keep)
    ok = F.col("session").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end") & (F.col("end") > F.col("start"))
    return one.filter(ok)
