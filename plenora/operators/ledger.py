"""Incremental runs: latest results, upserts, coverage and set comparisons."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_success(df: DataFrame, keys: Sequence[str], ok: Column, ts: str, keep: Sequence[str]) -> DataFrame:
    """Per key the latest successful row or, without any, the latest one. Ties go to the greatest kept values.

    An aggregate with a map-side part; null keys are a group of their own.
    """
    top = F.max(F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.col(ts), *[F.col(c) for c in keep])).alias("x")
    return df.groupBy(*keys).agg(top).select(*keys, "x.ok", F.col("x")[ts].alias(ts), *[F.col("x")[c].alias(c) for c in keep])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose keys are not in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def union_unique(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of both tables (missing columns null): of ``a`` where it has the key, the greatest of several."""
    cols = [c for c in a.columns if c not in keys]
    both = a.withColumn("__of", F.lit(1)).unionByName(b.withColumn("__of", F.lit(0)), allowMissingColumns=True)
    one = both.groupBy(*keys).agg(F.max(F.struct("__of", *cols)).alias("__x"))
    return one.select(*keys, *[F.col("__x")[c].alias(c) for c in cols])


def ledger_union(*ledgers: DataFrame) -> DataFrame:
    """What any of several ledgers has recorded, once."""
    out = ledgers[0]
    for x in ledgers[1:]:
        out = out.unionByName(x)
    return out.distinct()


def to_do(candidates: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that are not done."""
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def mark(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` with a flag for rows whose keys are in ``other``."""
    flag = other.select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(flag, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def coverage(corpus: DataFrame, key: str, hours: Column, subset: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: chunks and hours in and out of the subset, done and pending, and open errors."""
    m = mark(mark(mark(corpus, subset, [key], "in_subset"), done, [key], "done"), failed, [key], "failed").withColumn("__h", hours)
    h = lambda c: F.coalesce(F.sum(F.when(c, F.col("__h"))), F.lit(0.0))
    inside, d = F.col("in_subset"), F.col("done")
    return m.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(inside).alias("subset_chunks"), F.count_if(inside & d).alias("subset_done"), F.count_if(inside & ~d).alias("subset_pending"), F.count_if(~inside & d).alias("extra_done"),
        h(inside).alias("subset_hours"), h(inside & d).alias("done_hours"), F.count_if(F.col("failed") & ~d).alias("pending_errors"),
    )


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row about two key sets: sizes, overlap, only in a, only in b, equal, disjoint, a within b. Null keys are left out."""
    both = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1)).join(b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    only_a, only_b = F.col("n_a") - F.col("n_both"), F.col("n_b") - F.col("n_both")
    return n.select("*", only_a.alias("only_a"), only_b.alias("only_b"), ((only_a == 0) & (only_b == 0)).alias("equal"), (F.col("n_both") == 0).alias("disjoint"), (only_a == 0).alias("a_in_b"))


def multiset_difference(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``a`` beyond their number in ``b``: *cols, n."""
    ca = a.groupBy(*cols).agg(F.count(F.lit(1)).alias("na"))
    cb = b.groupBy(*cols).agg(F.count(F.lit(1)).alias("nb"))
    on = None
    r = cb.select(*[F.col(c).alias(f"__{c}") for c in cols], "nb")
    for c in cols:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = one if on is None else on & one
    return ca.join(r, on, "left").withColumn("n", F.col("na") - F.coalesce("nb", F.lit(0))).filter("n > 0").select(*cols, "n")


def _cuts(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows packed from a fresh shard at each of them: the row after its shard, what is pending after the last row, the shards closed."""
    m = len(sizes)
    cum = np.concatenate([[0], np.cumsum(sizes)])
    after = np.minimum(np.searchsorted(cum, cum[:-1] + limit, "left"), m + 1)  # m + 1: not closed here
    pending, closed = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(m - 1, -1, -1):
        if after[i] > m:
            pending[i] = cum[m] - cum[i]
        else:
            pending[i], closed[i] = pending[after[i]], closed[after[i]] + 1
    return after, pending, closed


def pack_by_size(df: DataFrame, order: Sequence[str], size: str, limit: int, chunk: str) -> DataFrame:
    """``df`` with ``shard``: rows in order fill a shard until its size reaches the limit; the row that does is its last.

    ``chunk`` is a column that rises with the order and whose groups fit a task
    (a bucket of the order, of many shards' size). What a chunk does depends on
    the size pending before it only through the place of its first cut, which
    lies within the chunk's first ``limit`` of size; these places are its
    summary, the summaries are folded in order, and every chunk is then cut on
    its own. Null sizes count as 0; rows are in order of (chunk, order), nulls first.
    """
    to = df.schema[chunk].dataType.simpleString()
    sizes = F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size")

    def summary(key: tuple, table: pa.Table) -> pa.Table:
        s = table.sort_by([(c, "ascending") for c in table.column_names if c.startswith("__o")]).column("__size").to_numpy()
        cum = np.cumsum(s)
        first = min(len(s), int(np.searchsorted(cum, limit, "left")) + 1)
        _, pending, closed = _cuts(s, limit)
        row = {"__chunk": [key[0].as_py()], "total": [int(cum[-1])], "cum": [cum[:first].tolist()], "pending": [pending[1 : first + 1].tolist()], "closed": [(closed[1 : first + 1] + 1).tolist()]}
        return pa.table(row, schema=pa.schema([("__chunk", table.schema.field(chunk).type), ("total", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("cum", "pending", "closed")]]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = 0, 0
        for b in batches:
            carry, base = [], []
            for total, cum, pending, closed in zip(*(b.column(c).to_pylist() for c in ("total", "cum", "pending", "closed"))):
                carry.append(held)
                base.append(shard)
                j = bisect_left(cum, limit - held)
                held, shard = (held + total, shard) if j == len(cum) else (pending[j], shard + closed[j])
            yield pa.RecordBatch.from_arrays([b.column("__chunk"), pa.array(carry, pa.int64()), pa.array(base, pa.int64())], names=["__chunk", "__carry", "__base"])

    keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    sums = df.filter(F.col(chunk).isNotNull()).select(chunk, sizes, *keys).groupBy(chunk).applyInArrow(summary, f"__chunk {to}, total long, cum array<long>, pending array<long>, closed array<long>")
    state = sums.repartition(1).sortWithinPartitions("__chunk").mapInArrow(fold, f"__chunk {to}, __carry long, __base long")
    fields = df.schema.fields
    both = df.join(state, F.col(chunk) == F.col("__chunk")).select(*df.columns, "__carry", "__base", sizes, *keys)

    def assign(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([(c, "ascending") for c in table.column_names if c.startswith("__o")])
        s, carry, base = t.column("__size").to_numpy(), t.column("__carry")[0].as_py(), t.column("__base")[0].as_py()
        shard, i, no, m = np.empty(len(s), np.int64), 0, base, len(s)
        cum = np.concatenate([[0], np.cumsum(s)])
        while i < m:
            end = min(m, int(np.searchsorted(cum, cum[i] + limit - carry, "left")))
            end = max(end, i + 1)
            shard[i:end] = no
            i, carry, no = end, 0, no + 1
        return t.select([f.name for f in fields]).append_column("shard", pa.array(shard))

    out = T.StructType([*fields, T.StructField("shard", T.LongType())])
    return both.groupBy(chunk).applyInArrow(assign, out)


def next_shard(names: DataFrame, col: str) -> DataFrame:
    """One row: 1 + the greatest number in ``...-<digits>.ext``, 0 for no such name."""
    n = F.nullif(F.regexp_extract(F.col(col), r"-(\d+)\.\w+$", 1), F.lit("")).try_cast("int")
    return names.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_shard"))


def latency_summary(df: DataFrame, keys: Sequence[str], seconds: str, amount: str | None = None) -> DataFrame:
    """Per key: rows, median, 95 % point and maximum of a duration and, with ``amount``, amount per second overall."""
    aggs = [F.count(F.lit(1)).alias("n"), F.percentile(seconds, 0.5).alias("median_s"), F.percentile(seconds, 0.95).alias("p95_s"), F.max(seconds).alias("max_s")]
    if amount:
        aggs.append((F.sum(amount) / F.nullif(F.sum(seconds), F.lit(0))).alias("per_second"))
    return df.groupBy(*keys).agg(*aggs)


def progress(df: DataFrame, ok: Column, amount: str, ts: str, total: float, cost_per_unit: float) -> DataFrame:
    """One row about a run log: rows done and failed, amount done, spend, projected spend, rate and seconds left."""
    done = F.coalesce(F.sum(F.when(ok, F.col(amount))), F.lit(0.0))
    a = df.agg(F.count_if(ok).alias("done"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), done.alias("amount"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("us"))
    rate = F.col("amount") / F.nullif(F.col("us") / 1e6, F.lit(0.0))
    return a.select("done", "failed", "amount", (F.col("amount") * cost_per_unit).alias("spend"), F.lit(total * cost_per_unit).alias("projected"), rate.alias("rate"), ((F.lit(float(total)) - F.col("amount")) / F.nullif(rate, F.lit(0.0))).alias("seconds_left"))


def queue_rollup(jobs: DataFrame, status: str, est: str, actual: str, cost_per_minute: float = 0.0) -> DataFrame:
    """Jobs by status: count, estimated and actual minutes, the median of actual over estimate, and what is left:
    minutes (estimates of jobs that have no actual time, times that median over all jobs) and their cost."""
    ratio = F.percentile(F.col(actual) / F.nullif(F.col(est), F.lit(0.0)), 0.5)
    all_ = jobs.agg(F.coalesce(ratio, F.lit(1.0)).alias("__r"))
    left = F.coalesce(F.sum(F.when(F.col(actual).isNull(), F.col(est))), F.lit(0.0))
    per = jobs.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.sum(est).alias("est"), F.sum(actual).alias("actual"), ratio.alias("ratio"), left.alias("__left"))
    done = per.crossJoin(F.broadcast(all_)).withColumn("minutes_left", F.col("__left") * F.col("__r"))
    return done.select(status, "n", "est", "actual", "ratio", "minutes_left", (F.col("minutes_left") * cost_per_minute).alias("cost_left"))
