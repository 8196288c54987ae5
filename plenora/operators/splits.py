"""Session-disjoint splits, nested budgets, pools and folds per speaker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.operators.chunked import running_sum


def session_split(df: DataFrame, speaker: str, session: str, duration_s: str, test_min: float, dev_min: float) -> DataFrame:
    """``df`` with ``part``: per speaker the newest sessions (by id) that fit in ``test_min`` minutes are test,
    or the newest one if none fits; dev likewise of the rest; all others train.

    Durations are summed per session before anything is windowed. Rows with a
    null speaker or session get a null part; empty input keeps the schema.
    """
    per = df.filter(F.col(speaker).isNotNull() & F.col(session).isNotNull()).groupBy(speaker, session).agg(F.coalesce(F.sum(duration_s), F.lit(0.0)).alias("__d"))
    w = W.partitionBy(speaker).orderBy(F.desc(session))
    cum = w.rowsBetween(W.unboundedPreceding, 0)
    one = per.withColumn("__c", F.sum("__d").over(cum) / 60).withColumn("__k", F.row_number().over(w)).withColumn("__test", (F.col("__c") <= test_min) | (F.col("__k") == 1))
    v = W.partitionBy(speaker, "__test").orderBy(F.desc(session))
    two = one.withColumn("__c2", F.sum("__d").over(v.rowsBetween(W.unboundedPreceding, 0)) / 60).withColumn("__k2", F.row_number().over(v))
    part = F.when(F.col("__test"), "test").when((F.col("__c2") <= dev_min) | (F.col("__k2") == 1), "dev").otherwise("train")
    return df.join(two.select(speaker, session, part.alias("part")), [speaker, session], "left")


def fill_to_targets(df: DataFrame, speaker: str, session_order: Sequence[Column], session: str, duration_s: str, targets: Sequence[tuple[str, float]]) -> DataFrame:
    """(speaker, session, part, minutes): parts filled in turn over the ordered sessions, each to the first
    session that reaches its target minutes, that session included; what is left has a null part."""
    keys = [c for c in df.columns if c in (speaker, session)]
    per = df.groupBy(*keys).agg((F.coalesce(F.sum(duration_s), F.lit(0.0)) / 60).alias("minutes"))
    w = W.partitionBy(speaker).orderBy(*session_order).rowsBetween(W.unboundedPreceding, 0)
    cur = per.withColumn("__cum", F.sum("minutes").over(w)).withColumn("__base", F.lit(0.0)).withColumn("part", F.lit(None).cast("string"))
    for part, target in targets:
        open_ = F.col("part").isNull()
        take = open_ & (F.col("__cum") - F.col("minutes") - F.col("__base") < target)
        cur = cur.withColumn("part", F.when(take, part).otherwise(F.col("part")))
        used = F.max(F.when(F.col("part").isNotNull(), F.col("__cum"))).over(W.partitionBy(speaker))
        cur = cur.withColumn("__base", F.coalesce(used, F.lit(0.0)))
    return cur.select(speaker, session, "part", "minutes")


def budget_order(df: DataFrame, speaker: str, order: Sequence[Column], duration_s: str) -> DataFrame:
    """``df`` with train_order (0-based) and budget_cum_min: every budget is a prefix of this one order."""
    w = W.partitionBy(speaker).orderBy(*order)
    return df.withColumn("train_order", F.row_number().over(w) - 1).withColumn("budget_cum_min", F.sum(F.coalesce(F.col(duration_s), F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)) / 60)


def round_robin_pool(df: DataFrame, speaker: str, order: Sequence[Column], minutes: str, budget: float) -> DataFrame:
    """Chunks taken in turn from each speaker's queue until the next one would exceed the budget, then none.

    The pool is bounded by its budget; rounds are numbered per speaker first
    and only rows that could still fit reach the final order.
    """
    w = W.partitionBy(speaker).orderBy(*order)
    rounds = df.withColumn("round", F.row_number().over(w) - 1).withColumn("__own", F.sum(minutes).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # A row whose speaker's own queue up to it exceeds the budget cannot be in the pool; the row that stops it may be the first such row.
    first_over = F.coalesce(F.lag("__own").over(w), F.lit(0.0)) <= budget
    some = rounds.withColumn("__fit", first_over).filter("__fit")
    total = running_sum(some, [], "round", [F.col(speaker)], F.col(minutes), "pool_cum")
    return total.filter(F.col("pool_cum") <= budget).drop("__own", "__fit")


def hash_folds(df: DataFrame, key: str, k: int, seed: int | str = 0) -> DataFrame:
    """(key, fold): distinct keys in the order of md5(seed|key), dealt out in turn to k folds."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    chunked = keys.withColumn("__h", at).withColumn("__chunk", F.substring("__h", 1, 3))
    ranked = running_sum(chunked, [], "__chunk", [F.col("__h"), F.col(key)], F.lit(1), "__rank")
    return ranked.select(key, ((F.col("__rank") - 1) % k).cast("int").alias("fold"))


def quota_sample(df: DataFrame, group: str, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows per group in the order of md5(seed|key): a reproducible stratified sample."""
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(at, key))).filter(F.col("__k") <= n).drop("__k")


def extends_plan(old: DataFrame, new: DataFrame, speaker: str, chunk: str) -> DataFrame:
    """Per speaker of the old plan: whether test and dev are the same sets and the old train order is a prefix of the new."""
    o = old.select(speaker, chunk, F.col("part").alias("o_part"), F.col("train_order").alias("o_at"))
    n = new.select(F.col(speaker).alias("__s"), F.col(chunk).alias("__c"), F.col("part").alias("n_part"), F.col("train_order").alias("n_at"))
    both = o.join(n, (F.col(speaker) == F.col("__s")) & (F.col(chunk) == F.col("__c")), "full_outer").withColumn("who", F.coalesce(F.col(speaker), F.col("__s")))
    held = F.col("o_part").isin("test", "dev") | F.col("n_part").isin("test", "dev")
    same = F.bool_and(~F.coalesce(held, F.lit(False)) | F.col("o_part").eqNullSafe(F.col("n_part")))
    prefix = F.bool_and(~(F.coalesce(F.col("o_part"), F.lit("")) == "train") | (F.col("n_part").eqNullSafe(F.lit("train")) & F.col("o_at").eqNullSafe(F.col("n_at"))))
    known = F.bool_or(F.col("o_part").isNotNull())
    return both.groupBy("who").agg(same.alias("same_held"), prefix.alias("prefix"), known.alias("known")).filter("known").select(F.col("who").alias(speaker), "same_held", "prefix")


def second_test_set(base: DataFrame, corpus: DataFrame, speaker: str, session: str, chunk: str, quality: str, least: float = 0.7) -> DataFrame:
    """Chunks of the base plan's test meetings (per speaker) at a lower quality bound, with ``hq`` for those in the
    base test. Base test chunks below the bound stay out; compare with ``ledger.compare_sets`` to assert a superset."""
    test = base.filter("part = 'test'")
    held = corpus.filter(F.col(quality) >= least).join(test.select(speaker, session).distinct(), [speaker, session], "left_semi")
    flag = test.select(chunk).distinct().withColumn("hq", F.lit(True))
    return held.join(flag, chunk, "left").withColumn("hq", F.coalesce("hq", F.lit(False)))


def companions(df: DataFrame, who: str, session: str, target: int, n: int) -> DataFrame:
    """The n others who share most meetings with ``target``, ties by id. Rows without identity (0, null) are left out."""
    met = df.filter(F.col(who) == target).select(session).distinct()
    shared = df.filter((F.col(who) > 0) & (F.col(who) != target)).select(who, session).distinct().join(met, session, "left_semi")
    return shared.groupBy(who).agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), who).limit(n)
