"""Ordered-sequence operators: islands, running targets, greedy packing, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.operators.chunked import running_sum

MAX_WINDOW_S = 30.0


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], identity: Sequence[str], out: str) -> DataFrame:
    """``df`` with the number of the maximal run of equal ``identity`` (null equals null) per key group.

    For groups that fit a task (a session); see chunked.py for larger ones.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__b", F.when(first | ~same, 1).otherwise(0)).withColumn(out, F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], flag: str, out: str) -> DataFrame:
    """Length of the longest run of rows with a true flag per key group; 0 if there is none."""
    marked = df.withColumn("__f", F.coalesce(F.col(flag), F.lit(False)))
    runs = islands(marked, keys, order, ["__f"], "__run").groupBy(*keys, "__run").agg(F.sum(F.col("__f").cast("int")).alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias(out))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str, out: str) -> DataFrame:
    """Inclusive running sum in a total order; null amounts count as 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(F.col(amount), F.lit(0))).over(w))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str, budget: Column) -> DataFrame:
    """The longest prefix whose running sum does not exceed the budget."""
    return running_total(df, keys, order, amount, "__cum").filter(F.col("__cum") <= budget).drop("__cum")


def until_target(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str, target: Column) -> DataFrame:
    """The shortest prefix that reaches the target, the row that crosses it included."""
    return running_total(df, keys, order, amount, "__cum").filter(F.col("__cum") - F.coalesce(F.col(amount), F.lit(0)) < target).drop("__cum")


def greedy_windows(df: DataFrame, keys: Sequence[str], start: str, end: str, cap: float = MAX_WINDOW_S) -> DataFrame:
    """Pack the spans of each group (one turn) into windows of at most ``cap`` seconds.

    Spans go in order of start, end. A span longer than the cap belongs to no
    window and the next one starts anew at the following span's start. A span
    joins the window while it ends within ``cap`` of the window's seek point;
    otherwise a new window begins, seeking at the end of the last one if the
    span then fits, else at its own start. A window's start is its seek point,
    so a gap before its first span belongs to it. Spans with null or reversed
    times are left out. One fold per group over its sorted array: use on groups
    of turn size. Output: *keys, window, seek, end, n_spans.
    """
    spans = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    arr = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")))).alias("xs"))
    state = "struct<seek: double, last: double, no: int, out: array<struct<window: int, seek: double, s: double, e: double>>>"
    zero = F.expr(f"cast(named_struct('seek', null, 'last', null, 'no', 0, 'out', array()) as {state})")

    def step(acc: Column, x: Column) -> Column:
        long = x["e"] - x["s"] > cap
        fresh = acc["seek"].isNull()
        fits = ~fresh & (x["e"] <= acc["seek"] + cap)
        after = ~fresh & (x["e"] <= acc["last"] + cap) & (x["s"] >= acc["last"])
        seek = F.when(fits, acc["seek"]).when(after, acc["last"]).otherwise(x["s"])
        no = F.when(fits, acc["no"]).otherwise(acc["no"] + 1)
        took = F.struct(seek.alias("seek"), F.greatest(x["e"], F.when(fits, acc["last"])).alias("last"), no.alias("no"), F.concat(acc["out"], F.array(F.struct(no.alias("window"), seek.alias("seek"), x["s"].alias("s"), x["e"].alias("e")))).alias("out"))
        skipped = F.struct(F.lit(None).cast("double").alias("seek"), F.lit(None).cast("double").alias("last"), acc["no"].alias("no"), acc["out"].alias("out"))
        return F.when(long, skipped).otherwise(took).cast(state)

    packed = arr.select(*keys, F.explode(F.aggregate("xs", zero, step, lambda acc: acc["out"])).alias("p"))
    return packed.groupBy(*keys, F.col("p.window").alias("window")).agg(F.min("p.seek").alias("seek"), F.max("p.e").alias("end"), F.count(F.lit(1)).alias("n_spans"))


def split_long_runs(words: DataFrame, keys: Sequence[str], order: str, start: str, end: str, cap: float = 30.0, least: float = 1.0) -> DataFrame:
    """Cut a run of timed words into pieces of at most ``cap`` seconds at word borders; pieces outside
    [least, cap] are left out. Output: *keys, piece, start, end, n_words."""
    ok = words.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    arr = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")))).alias("xs"))
    state = "struct<from: double, no: int, out: array<struct<no: int, s: double, e: double>>>"
    zero = F.expr(f"cast(named_struct('from', null, 'no', 0, 'out', array()) as {state})")

    def step(acc: Column, x: Column) -> Column:
        new = acc["from"].isNull() | (x["e"] - acc["from"] > cap)
        no = acc["no"] + new.cast("int")
        return F.struct(F.when(new, x["s"]).otherwise(acc["from"]).alias("from"), no.alias("no"), F.concat(acc["out"], F.array(F.struct(no.alias("no"), x["s"].alias("s"), x["e"].alias("e")))).alias("out")).cast(state)

    cutted = arr.select(*keys, F.explode(F.aggregate("xs", zero, step, lambda acc: acc["out"])).alias("p"))
    pieces = cutted.groupBy(*keys, F.col("p.no").alias("piece")).agg(F.min("p.s").alias("start"), F.max("p.e").alias("end"), F.count(F.lit(1)).alias("n_words"))
    return pieces.filter((F.col("end") - F.col("start") >= least) & (F.col("end") - F.col("start") <= cap))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged, 1 to n; null values get none.

    Counted per distinct value first, so only distinct values are windowed.
    Without keys the values are cut at approximate quantiles and summed up
    chunk by chunk, so no task sees them all.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    if keys:
        summed = per.withColumn("__upto", F.sum("__n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    else:
        edges = per.agg(F.percentile_approx(F.col(value).cast("double"), [k / 64 for k in range(1, 64)]).alias("__edges"))
        chunked = per.crossJoin(F.broadcast(edges)).withColumn("__chunk", F.size(F.filter("__edges", lambda x: x < F.col(value)))).drop("__edges")
        summed = running_sum(chunked, [], "__chunk", [F.col(value)], F.col("__n"), "__upto").drop("__chunk")
    ranked = summed.withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2.0).drop("__n", "__upto")
    return df.join(ranked, [*keys, value], "left")


def early_stop(curve: DataFrame, keys: Sequence[str], step: str, loss: str, patience: int, min_steps: int = 0) -> DataFrame:
    """Step at which training stops: after ``patience`` checks without a new least loss, counted from
    ``min_steps`` on; the last step if that never happens. Output: *keys, best_step, stop_step."""
    w = W.partitionBy(*keys).orderBy(step)
    best = F.min(loss).over(w.rowsBetween(W.unboundedPreceding, -1))
    at = curve.withColumn("__new", F.when(best.isNull() | (F.col(loss) < best), 1).otherwise(0)).withColumn("__check", F.when(F.col(step) >= min_steps, 1).otherwise(0))
    seg = at.withColumn("__seg", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    in_seg = W.partitionBy(*keys, "__seg").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    bad = seg.withColumn("__bad", F.sum(F.when((F.col("__new") == 0) & (F.col("__check") == 1), 1).otherwise(0)).over(in_seg))
    stop = F.min(F.when(F.col("__bad") >= patience, F.col(step)))
    return bad.groupBy(*keys).agg(F.min_by(step, F.struct(loss, step)).alias("best_step"), F.coalesce(stop, F.max(step)).alias("stop_step"))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, n: int, out: str) -> DataFrame:
    """Mean of the row and the n - 1 rows before it, of as many as there are."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(out, F.avg(value).over(w))


def suffix_share(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """Share of the group's total that the row and all rows after it hold; null for a total of 0."""
    rest = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn(out, F.sum(value).over(rest) / F.nullif(F.sum(value).over(W.partitionBy(*keys)), F.lit(0)))


def previous_kept(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], kept: Column, text: str, out: str) -> DataFrame:
    """Kept rows with the text of the row before them in the group, null at its start and where that row was dropped:
    a dropped row breaks the chain. A null condition drops the row."""
    w = W.partitionBy(*keys).orderBy(*order)
    ok = F.coalesce(kept, F.lit(False))
    return df.withColumn("__ok", ok).withColumn(out, F.when(F.lag("__ok").over(w), F.lag(text).over(w))).filter("__ok").drop("__ok")


def usable_chunk(start: Column, end: Column, audio_s: Column, slack: float = 0.05, least: float = 1.0) -> Column:
    """Whether a chunk lasts ``least`` seconds and ends no more than ``slack`` beyond its audio."""
    return (end - start >= least) & (end <= audio_s + slack)


def median_while_present(df: DataFrame, series: str, step: str, value: str, digits: int = 9) -> DataFrame:
    """(step, median, n) over all series, as long as at least half of them have the step."""
    all_ = df.agg(F.countDistinct(series).alias("__all"))
    per = df.groupBy(step).agg(F.round(F.percentile(value, 0.5), digits).alias("median"), F.countDistinct(series).alias("n"))
    return per.crossJoin(F.broadcast(all_)).filter(F.col("n") * 2 >= F.col("__all")).drop("__all")


def curve_minimum(df: DataFrame, keys: Sequence[str], step: str, loss: str, digits: int = 9) -> DataFrame:
    """(keys, best_step, best): a curve divided by its first value, its least value and the first step that has it."""
    at = F.struct(F.col(loss), F.col(step))
    one = df.filter(F.col(loss).isNotNull()).groupBy(*keys).agg(F.min_by(loss, step).alias("__first"), F.min(at).alias("__m"))
    return one.select(*keys, F.col("__m")[step].alias("best_step"), F.round(F.col("__m")[loss] / F.nullif(F.col("__first"), F.lit(0.0)), digits).alias("best"))
