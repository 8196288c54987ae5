"""Results of adapted models: personal margins, grids of settings, fold plans, widening and estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.functions.text import safe_ratio
from plenora.operators.decide import with_fallback
from plenora.operators.stats import paired_bootstrap


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the axes' values, one row each, in columns of their names."""
    out = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(f"__{k}") for k, values in axes.items()])
    for k in axes:
        out = out.select("*", F.explode(f"__{k}").alias(k)).drop(f"__{k}")
    return out


def error_shares(df: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """``df`` with the share of each error column (name -> column) of their sum; null where there is no error."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in parts.values()), F.lit(0))
    return df.withColumns({k: safe_ratio(F.col(c), total) for k, c in parts.items()})


def personal_margins(own: DataFrame, control: DataFrame, keys: Sequence[str], budget: str, delta: str, base: str, default_budget: int) -> DataFrame:
    """``own`` with control (of the same keys and budget, or of the default budget where no row of that budget has one),
    margin = own - control and its share of the base rate."""
    both = with_fallback(own, control, keys, budget, delta, default_budget)
    margin = F.col(delta) - F.col("control")
    return both.withColumn("margin", margin).withColumn("margin_rel", safe_ratio(margin, F.col(base)))


def level_difference(df: DataFrame, keys: Sequence[str], level: str, low: object, high: object, value: str) -> DataFrame:
    """(keys, low, high, difference) of rows that have both levels; the keys' rows of a level are averaged first."""
    sides = [df.filter(F.col(level) == v).groupBy(*keys).agg(F.avg(value).alias(n)) for v, n in ((low, "low"), (high, "high"))]
    return sides[0].join(sides[1], list(keys)).withColumn("difference", F.col("high") - F.col("low"))


def mean_over_seeds(df: DataFrame, keys: Sequence[str], seed: str, values: Sequence[str]) -> DataFrame:
    """Mean of each value over the rows of a key, and the number of different seeds."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.countDistinct(seed).alias("seeds"))


def significance_tally(df: DataFrame, keys: Sequence[str], delta: str, lo: str, hi: str) -> DataFrame:
    """Per key: rows that improve or get worse, each with an interval clear of 0 or not."""
    clear = (F.col(lo) > 0) | (F.col(hi) < 0)
    up = F.col(delta) > 0
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(*keys).agg(count(up & clear).alias("better"), count(up & ~clear).alias("better_unclear"), count(~up & ~clear).alias("worse_unclear"), count(~up & clear).alias("worse"))


def joined_difference(df: DataFrame, group: str, order: Sequence[str], control: str, own: str, words: str, joined: DataFrame, column: str, n_boot: int = 2000) -> DataFrame:
    """Paired bootstrap of control against own errors with ``agrees``: whether its point estimate equals, to 1e-9, the
    difference in the joined results table (group, column)."""
    ci = paired_bootstrap(df, group, order, control, own, words, n_boot, "joined", digits=12)
    return ci.join(joined.select(group, F.col(column).alias("__j")), group, "left").withColumn("agrees", F.coalesce(F.abs(F.col("delta") - F.col("__j")) < 1e-9, F.lit(False))).drop("__j")


def paired_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both tables, in one only, and keys that a table has more than once."""
    one = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = one(a, "na").join(one(b, "nb"), list(keys), "full_outer")
    return both.agg(F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("paired"), F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"))


def widened_sessions(df: DataFrame, speaker: str, session: str, minutes: Column, test: float, dev: float, train: float) -> DataFrame:
    """(speaker, session, part, minutes): the newest sessions, taken until test, dev and train are filled in turn, each to
    the first session that reaches its minutes; ``enough`` tells whether train did before the sessions ran out.

    Adding one session at a time and filling anew ends with the same sessions
    as three thresholds on one running sum, each from the end of the part before.
    """
    per = df.filter(F.col(speaker).isNotNull() & F.col(session).isNotNull()).groupBy(speaker, session).agg(F.sum(minutes).alias("minutes"))
    w = W.partitionBy(speaker).orderBy(F.desc(session)).rowsBetween(W.unboundedPreceding, 0)
    cur = per.withColumn("__c", F.sum("minutes").over(w)).withColumn("part", F.lit(None).cast("string")).withColumn("__b", F.lit(0.0))
    every = W.partitionBy(speaker)
    for part, want in (("test", test), ("dev", dev), ("train", train)):
        cur = cur.withColumn("part", F.when(F.col("part").isNull() & (F.col("__c") - F.col("minutes") - F.col("__b") < want), part).otherwise(F.col("part")))
        if part == "train":
            cur = cur.withColumn("enough", F.coalesce(F.sum(F.when(F.col("part") == "train", F.col("minutes"))).over(every) >= want, F.lit(False)))
        cur = cur.withColumn("__b", F.coalesce(F.max(F.when(F.col("part").isNotNull(), F.col("__c"))).over(every), F.lit(0.0)))
    return cur.filter("part IS NOT NULL").select(speaker, session, "part", "minutes", "enough")


def fold_plan(folds: DataFrame, extras: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """Folds (key, fold) with extras (key, attach) put into the fold of the key they are attached to, ``extra`` true.

    With ``wanted`` (a table of keys to evaluate) other keys are dropped, and so
    are folds left without any. An extra whose key is not in a fold is left out.
    """
    more = extras.join(folds.select(F.col(key).alias("attach"), "fold"), "attach").select(key, "fold", F.lit(True).alias("extra"))
    plan = folds.select(key, "fold").join(extras.select(key), key, "left_anti").select(key, "fold", F.lit(False).alias("extra")).unionByName(more)
    return plan if wanted is None else plan.join(wanted.select(key).distinct(), key, "left_semi")


def pool_without_held(pool: DataFrame, held: DataFrame, session: str) -> DataFrame:
    """Pool rows of sessions in which no evaluated speaker has test or dev rows; ``held`` has session and part."""
    bad = held.filter(F.col("part").isin("test", "dev")).select(session).distinct()
    return pool.join(bad, session, "left_anti")


def stage_settings(pick: Mapping[str, object], stages: Mapping[str, Sequence[str]], options: Mapping[str, Sequence], done: Sequence[str]) -> list[dict]:
    """The settings of the next stage of a staged grid: one axis group varied in full around the picks so far.

    ``stages`` (in order) names each stage's axes; the first stage not in
    ``done`` is next. Asking for a stage whose predecessors are not done cannot
    happen; when all are done the list is empty. Driver-side: a handful of rows.
    """
    from itertools import product

    for stage, axes in stages.items():
        if stage not in done:
            return [dict(pick) | dict(zip(axes, values)) | {"stage": stage} for values in product(*(options[a] for a in axes))]
    return []


def top_budget(train_minutes: Column, want: int = 1440, otherwise: int = 1200) -> Column:
    """The top budget in minutes: ``want`` where there are so many train minutes, else ``otherwise``."""
    return F.when(train_minutes >= want, want).otherwise(otherwise)


def step_estimate(chunks: Column, epochs: Column, batch: int = 8, least: int = 1) -> Column:
    """Optimizer steps of a job: epochs times whole batches, at least ``least``."""
    return F.greatest(F.ceil(chunks / batch) * epochs, F.lit(least))


def source_cost(spans: DataFrame, session: str, turn: str, start: str, end: str, bytes_a_second: float) -> DataFrame:
    """Per session: turns, seconds of turn spans (from a turn's first start to its last end), and bytes to fetch, rounded up."""
    per = spans.groupBy(session, turn).agg((F.max(end) - F.min(start)).alias("s"))
    return per.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.sum("s").alias("seconds"), F.ceil(F.sum("s") * bytes_a_second).alias("bytes"))


def sample_index(seconds: Column, rate: int = 16_000) -> Column:
    """Index of the sample at a time: rounded, halves to even, not cut off."""
    return F.bround(seconds * rate).cast("long")


def near(a: Column, b: Column, eps: float) -> Column:
    """Whether two numbers differ by less than eps; false for null."""
    return F.coalesce(F.abs(a - b) < eps, F.lit(False))
