"""Selection and sampling of rows: optional filters, quality rules, candidate lists, seeded samples and quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word-quality bounds: relative gap of the word counts, share and longest run of words of low probability.
MAX_GAP, MAX_LOW_SHARE, MAX_LOW_RUN = 0.2, 0.10, 3


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """md5(seed|keys): an order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows without replacement in the order of md5(seed|key), ties by key: the same on every run and partitioning."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def hash_part(df: DataFrame, key: str, parts: int, part: int) -> DataFrame:
    """Rows whose crc32(key) leaves ``part`` modulo ``parts``; null keys are in no part."""
    return df.filter(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == part)


def select_rows(df: DataFrame, key: str, speakers: Sequence[int] | None = None, sessions: Sequence[int] | None = None, min_quality: float | None = None, min_s: float | None = None, max_s: float | None = None, ids: DataFrame | None = None, limit: int | None = None, seed: int | str | None = None) -> DataFrame:
    """Rows that meet every given condition (a null value meets none), and of these ``limit`` in key order or,
    with a seed, in seeded order. ``ids`` is a table with the key column; speakers, sessions and quality are the
    columns speaker_id, session, quality, duration_s."""
    out = df
    for col, values in (("speaker_id", speakers), ("session", sessions)):
        if values is not None:
            out = out.filter(F.col(col).isin(list(values)))
    for cond in ((F.col("quality") >= min_quality) if min_quality is not None else None, (F.col("duration_s") >= min_s) if min_s is not None else None, (F.col("duration_s") <= max_s) if max_s is not None else None):
        if cond is not None:
            out = out.filter(cond)
    if ids is not None:
        out = out.join(ids.select(key).distinct(), key, "left_semi")
    if limit is None:
        return out
    return seeded_sample(out, key, limit, seed) if seed is not None else out.orderBy(key).limit(limit)


def words_ok(n_words: Column, n_ref: Column, low_share: Column, low_run: Column, max_low_share: float = MAX_LOW_SHARE) -> Column:
    """Whether a chunk's words fit its reference: counts differ by no more than MAX_GAP of the reference's (at least one),
    few words are of low probability, and no MAX_LOW_RUN of them follow each other. Null is not ok."""
    gap = F.abs(n_words - n_ref) / F.greatest(n_ref, F.lit(1))
    return F.coalesce((gap <= MAX_GAP) & (low_share <= max_low_share) & (low_run < MAX_LOW_RUN), F.lit(False))


def without(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the exclusion list; rows with a null key stay."""
    return df.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def candidate_rows(df: DataFrame, speaker: str, session: str, date: str, minutes: Column, target: float) -> DataFrame:
    """Rows of each speaker's newest sessions (by date, then id) up to and with the one that reaches the target minutes."""
    per = df.filter(F.col(speaker).isNotNull() & F.col(session).isNotNull()).groupBy(speaker, session).agg(F.max(date).alias("__d"), F.sum(minutes).alias("__m"))
    cum = F.sum("__m").over(W.partitionBy(speaker).orderBy(F.desc("__d"), F.desc(session)).rowsBetween(W.unboundedPreceding, 0))
    keep = per.withColumn("__c", cum).filter(F.col("__c") - F.col("__m") < target).select(speaker, session)
    return df.join(keep, [speaker, session], "left_semi")


def band(col: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Label of the half-open band lo <= x < hi; null outside all bands and for null. (``binning.cut`` closes bands on the right.)"""
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 1):
        out = F.when((col >= edges[k]) & (col < edges[k + 1]), labels[k] if labels else f"[{edges[k]:g}, {edges[k + 1]:g})").otherwise(out)
    return out


def quota_of_groups(df: DataFrame, group: str, subgroup: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first rows of every (group, subgroup) in order: n shared by the group's subgroups, at least one each."""
    subs = df.groupBy(group).agg(F.countDistinct(subgroup).alias("__k"))
    ranked = df.withColumn("__i", F.row_number().over(W.partitionBy(group, subgroup).orderBy(*order)))
    return ranked.join(subs, group).filter(F.col("__i") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("__k")))).drop("__i", "__k")


def spread_sample(df: DataFrame, group: str, session: str, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows per group in seeded order, one per session where the group has at least n sessions."""
    at = seeded_order(seed, F.col(key))
    ranked = df.withColumn("__i", F.row_number().over(W.partitionBy(group, session).orderBy(at, key))).join(df.groupBy(group).agg(F.countDistinct(session).alias("__s")), group)
    some = ranked.filter((F.col("__s") < n) | (F.col("__i") == 1))
    return some.withColumn("__j", F.row_number().over(W.partitionBy(group).orderBy(at, key))).filter(F.col("__j") <= n).drop("__i", "__s", "__j")


def first_by(value: Column, *order: Column) -> Column:
    """Aggregate: the first value that is not null in the given order."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def attach_wide(rows: DataFrame, wide: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Left join of late, wide columns by a key that must be unique on their side: a repeated key stops the job
    instead of multiplying rows. Only the key and ``cols`` of the wide side are read."""
    one = wide.groupBy(key).agg(F.max(F.struct(*cols)).alias("__w"), F.count(F.lit(1)).alias("__n"))
    stop = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("not unique: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    guarded = one.withColumn("__ok", stop).filter("__ok").select(key, "__w")
    return rows.join(guarded, key, "left").select(*rows.columns, *[F.col("__w")[c].alias(c) for c in cols])
