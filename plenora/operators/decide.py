"""Decision rules over small result tables, job graphs and schedules."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenora.session import written

MIN_GAIN, MIN_HELPED = 0.01, 3


def replace_incumbent(drops: DataFrame, group: Sequence[str], candidate: str, speaker: str, drop: str, incumbent: Column, speakers: int = 4) -> DataFrame:
    """Per group the winning candidate: of those that beat the incumbent by MIN_GAIN on average and for at
    least MIN_HELPED speakers, the one of the greatest mean; else the incumbent. ``complete`` is false, and
    nothing wins, where a candidate lacks a speaker."""
    base = drops.filter(incumbent).select(*group, speaker, F.col(drop).alias("__base"))
    cmp = drops.join(base, [*group, speaker], "left")
    per = cmp.groupBy(*group, candidate).agg(F.avg(drop).alias("mean"), F.avg(F.col(drop) - F.col("__base")).alias("gain"), F.count_if(F.col(drop) > F.col("__base")).alias("helped"), F.countDistinct(speaker).alias("n"), F.bool_or(incumbent).alias("inc"))
    wins = (F.col("gain") >= MIN_GAIN - 1e-12) & (F.col("helped") >= MIN_HELPED)
    pick = per.groupBy(*group).agg(F.bool_and(F.col("n") == speakers).alias("complete"), F.max_by(candidate, F.when(wins & ~F.col("inc"), F.struct("mean", candidate))).alias("__win"), F.max(F.when(F.col("inc"), F.col(candidate))).alias("__inc"))
    return pick.select(*group, "complete", F.when(F.col("complete"), F.coalesce("__win", "__inc")).alias("winner"))


def curve_verdict(df: DataFrame, delta: str = "delta", lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """One row: 'limits' if two or more deltas are at least 0.02 with an interval above 0, 'does not limit' if
    every interval holds 0 and stays below 0.02, else 'undecided' (also for no rows)."""
    a = df.agg(F.count_if((F.col(delta) >= 0.02) & (F.col(lo) > 0)).alias("up"), F.bool_and((F.col(lo) <= 0) & (F.col(hi) >= 0) & (F.col(hi) < 0.02)).alias("flat"))
    return a.select(F.when(F.col("up") >= 2, "limits").when(F.coalesce("flat", F.lit(False)), "does not limit").otherwise("undecided").alias("verdict"))


def base_check(base: DataFrame, known: DataFrame, key: str, rate: str, tolerance: float = 0.10) -> DataFrame:
    """Keys whose base rate exceeds the known one by more than the tolerance; any row stops a run."""
    k = known.select(key, F.col(rate).alias("known"))
    return base.join(k, key).filter(F.col(rate) - F.col("known") > tolerance).select(key, rate, "known")


def insertion_source(wer_base: Column, wer_tuned: Column, i_base: Column, i_tuned: Column) -> Column:
    """Share of a gain that comes from insertions, clipped to [-5, 5]; null without a difference."""
    gain = wer_base - wer_tuned
    return F.when(gain != 0, F.greatest(F.least((i_base * wer_base - i_tuned * wer_tuned) / gain, F.lit(5.0)), F.lit(-5.0)))


def with_fallback(own: DataFrame, control: DataFrame, keys: Sequence[str], budget: str, value: str, default_budget: int) -> DataFrame:
    """``own`` with the control value of the same keys and budget or, where no row of that budget has one, of the default budget."""
    same = control.select(*keys, budget, F.col(value).alias("__same"))
    other = control.filter(F.col(budget) == default_budget).select(*keys, F.col(value).alias("__other"))
    any_ = control.filter(F.col(value).isNotNull()).select(budget).distinct().withColumn("__has", F.lit(True))
    j = own.join(same, [*keys, budget], "left").join(other, list(keys), "left").join(any_, budget, "left")
    return j.withColumn("control", F.when(F.coalesce("__has", F.lit(False)), F.col("__same")).otherwise(F.col("__other"))).drop("__same", "__other", "__has")


def job_states(jobs: DataFrame) -> DataFrame:
    """``jobs`` (id, deps array, status) with ``ready`` (pending, all dependencies done) and ``dead`` (pending with a failed ancestor).

    Each round marks jobs that wait for a failed or dead one and lets the other
    edges skip a job with one dependency, so a chain of any length takes as many
    rounds as its length has binary digits. A dependency that is no job is never done.
    """
    edges = written(jobs.select("id", F.explode("deps").alias("dep")).distinct())
    dead = jobs.filter("status = 'failed'").select(F.col("id").alias("dep"), F.lit(True).alias("bad"))
    live, mark = edges, None
    while True:
        only = live.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("next")).select(F.col("id").alias("dep"), "n", "next")
        seen = live.join(dead, "dep", "left").join(only, "dep", "left")
        # An edge to a job that is not bad and waits for nothing shows nothing; the way through one dependency is taken at once.
        nxt = seen.filter("bad OR n IS NOT NULL").select("id", F.when(F.col("bad").isNull() & (F.col("n") == 1), F.col("next")).otherwise(F.col("dep")).alias("dep")).filter("id <> dep").distinct()
        live = written(nxt)
        dead = written(dead.unionByName(live.join(dead, "dep", "left_semi").select(F.col("id").alias("dep"), F.lit(True).alias("bad"))).distinct())
        state = live.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "dep"))).first(), dead.count()
        if state == mark:
            break
        mark = state
    waits = edges.join(jobs.select(F.col("id").alias("dep"), "status"), "dep", "left").filter("status IS NULL OR status <> 'done'").select("id").distinct().withColumn("waits", F.lit(True))
    j = jobs.join(dead.select(F.col("dep").alias("id"), F.col("bad").alias("is_dead")), "id", "left").join(waits, "id", "left")
    pending = F.col("status") == "pending"
    return j.select(*jobs.columns, (pending & F.col("waits").isNull()).alias("ready"), (pending & F.coalesce("is_dead", F.lit(False))).alias("dead"))


def finished(jobs: DataFrame) -> DataFrame:
    """One row: whether a queue of ``job_states`` is at its end: nothing runs or is on hold, and all pending jobs are dead."""
    return jobs.agg(F.coalesce(F.bool_and(~F.col("status").isin("running", "hold") & ((F.col("status") != "pending") | F.col("dead"))), F.lit(True)).alias("finished"))


def simulate_schedule(jobs: Sequence[dict], workers: int) -> float:
    """Wall time of list scheduling: each free worker takes the ready job of greatest (prio, est). Driver-side, for small graphs."""
    left, done, running, now = {j["id"]: j for j in jobs}, set(), [], 0.0
    while left or running:
        ready = sorted((j for j in left.values() if set(j["deps"]) <= done), key=lambda j: (-j["prio"], -j["est"], j["id"]))
        for j in ready[: workers - len(running)]:
            heapq.heappush(running, (now + j["est"], j["id"]))
            del left[j["id"]]
        if not running:
            raise ValueError("jobs wait for one another or for something that is not there")
        now, who = heapq.heappop(running)
        done.add(who)
    return now
