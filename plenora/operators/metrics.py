"""Pooled ratios, subgroup tables and other aggregates. Counts are summed, rates are ratios of sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.functions.text import safe_ratio


def total(col: Column | str) -> Column:
    """Sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(col), F.lit(0))


def share(pred: Column) -> Column:
    """Share of rows for which a predicate holds; null counts as false."""
    return F.avg(F.coalesce(pred, F.lit(False)).cast("double"))


def pooled_rates(df: DataFrame, keys: Sequence[str], words: str, errors: Mapping[str, str], extra: Sequence[Column] = ()) -> DataFrame:
    """Per group: chunks, words, errors and rate of each arm (name -> error column); null rate for 0 words.

    Rows with a null key form no group. Partial sums are combined on the map
    side, so a group with most rows costs one row a task.
    """
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else df
    aggs = [F.count(F.lit(1)).alias("chunks"), total(words).alias("words"), *[total(c).alias(f"err_{a}") for a, c in errors.items()], *extra]
    g = rows.groupBy(*keys).agg(*aggs)
    return g.select("*", *[safe_ratio(F.col(f"err_{a}"), F.col("words")).alias(f"rate_{a}") for a in errors])


def with_gain(df: DataFrame, base: str, better: str) -> DataFrame:
    """Absolute and relative gain of one rate over another."""
    gain = F.col(base) - F.col(better)
    return df.withColumn("gain_abs", gain).withColumn("gain_rel", safe_ratio(gain, F.col(base)))


def threshold_effect(df: DataFrame, keep: Column, words: str, errors: Mapping[str, str]) -> DataFrame:
    """What a filter does: rows 'before', 'after' and 'dropped' with pooled rates. A null predicate drops the row."""
    sides = df.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("side", F.explode(F.array(F.lit("before"), F.when(F.col("__keep"), "after").otherwise("dropped"))))
    return pooled_rates(sides, ["side"], words, errors)


def subgroups(df: DataFrame, rules: Mapping[str, str], member_hours: str, words: str, errors: Mapping[str, str], not_groups: Sequence[str] = ("Unknown", "Unrecorded"), min_members: int = 3, min_hours: float = 5.0) -> DataFrame:
    """One row per (rule, group): members, hours, hours without the largest member, pooled rates, viability.

    ``df`` has one row per member; ``rules`` maps a rule's name to the column
    with the member's group. One pass over all rules. Null groups are left out.
    """
    each = df.select("*", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("string").alias("grp")) for r, c in rules.items()])).alias("__r")).select("*", "__r.rule", "__r.grp").drop("__r")
    hours = [total(member_hours).alias("hours"), (total(member_hours) - F.coalesce(F.max(member_hours), F.lit(0))).alias("hours_minus_largest")]
    t = pooled_rates(each.filter("grp IS NOT NULL"), ["rule", "grp"], words, errors, hours).withColumnRenamed("chunks", "members")
    viable = (F.col("members") >= min_members) & (F.col("hours_minus_largest") >= min_hours) & ~F.col("grp").isin(*not_groups)
    return t.withColumn("viable", viable)


def keep_large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return df.join(big.select(group), group, "left_semi")


def eta_squared(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Between-group over total variance of ``value`` per key; null where nothing varies.

    Two levels of sums; rows with a null group or value are left out.
    """
    ok = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    v = F.col(value)
    per = ok.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"), F.sum(v).alias("__s"), F.sum(v * v).alias("__q"))
    all_ = per.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum("__s").alias("__sum"), F.sum("__q").alias("__sq"), F.sum(F.col("__s") * F.col("__s") / F.col("__n")).alias("__between"))
    mean2 = F.col("__sum") * F.col("__sum") / F.col("n")
    return all_.select(*keys, "n", safe_ratio(F.col("__between") - mean2, F.col("__sq") - mean2).alias("eta2"))


def majority_key(pairs: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """Per key the most frequent value with its count and purity, and whether it is usable (pure, often enough).

    Ties go to the smallest value. Null keys or values are left out.
    """
    per = pairs.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"), F.sum("n").alias("__all"))
    return best.select(key, value, "n", (F.col("n") / F.col("__all")).alias("purity"), ((F.col("n") == F.col("__all")) & (F.col("n") >= least)).alias("usable"))


def top_counts(df: DataFrame, keys: Sequence[str], count: str, order: Sequence[str], n: int) -> DataFrame:
    """The n rows of greatest count per key group, ties by ``order``, with their rank."""
    w = W.partitionBy(*keys).orderBy(F.desc(count), *order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pivot_arms(long: DataFrame, key: str, arm: str, arms: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with ``col_arm`` columns and ``has_arm`` flags. The greatest value stands for repeats."""
    aggs = [F.max(F.when(F.col(arm) == a, F.col(c))).alias(f"{c}_{a}") for a in arms for c in cols]
    return long.groupBy(key).agg(*aggs, *[F.coalesce(F.max(F.col(arm) == a), F.lit(False)).alias(f"has_{a}") for a in arms])


def best_column(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per row the column of least value (first in order on ties), its value and the gap to the runner-up."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x")).filter("x.v IS NOT NULL")
    w = W.partitionBy(key).orderBy("x.v", "x.i")
    ranked = long.withColumn("k", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.max(F.when(F.col("k") == 1, F.col("x.c"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("x.v"))).alias("value"), (F.max(F.when(F.col("k") == 2, F.col("x.v"))) - F.max(F.when(F.col("k") == 1, F.col("x.v")))).alias("gap"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, weight: Column | None = None) -> DataFrame:
    """Equal-width histogram on [lo, hi], top edge included: bin (0-based), n, weight. Values outside are left out."""
    x = F.col(col)
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    ok = df.filter((x >= lo) & (x <= hi))
    return ok.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), total(weight if weight is not None else F.lit(1)).alias("weight"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float], amount: str) -> DataFrame:
    """Sum of ``amount`` that survives each threshold per key group, in one pass."""
    each = df.select(*keys, amount, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), (F.col(value) >= t).alias("ok")) for t in thresholds])).alias("x"))
    return each.groupBy(*keys, F.col("x.t").alias("threshold")).agg(total(F.when(F.col("x.ok"), F.col(amount))).alias("surviving"))


def weighted_shares(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Share of each group by rows and by weight."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), total(weight).alias("w"))
    tot = g.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return g.crossJoin(F.broadcast(tot)).select(group, (F.col("n") / F.col("all_n")).alias("share_rows"), safe_ratio(F.col("w"), F.col("all_w")).alias("share_weight"))


def map_values(col: Column, mapping: Mapping[str, str], default: str | None) -> Column:
    """The value a mapping gives; null and what it does not know get the default. ``unmapped`` lists the latter."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.lit(default))


def unmapped(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """(value, n): values other than null that a mapping does not know."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*mapping)).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, keys: Sequence[str], value: str, digits: int = 9) -> DataFrame:
    """(keys, n, mean, sd, cv): sample standard deviation and its share of the mean; null for a mean of 0 and fewer than two values."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.select(*keys, "n", *[F.round(c, digits).alias(n) for c, n in ((F.col("mean"), "mean"), (F.col("sd"), "sd"), (safe_ratio(F.col("sd"), F.col("mean")), "cv"))])
