"""Interval algebra: merged periods and gaps, binned range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenora.operators.chunked import next_value, running_sum

#: Width of a sweep chunk in ms. After pre-aggregation a (group, chunk) holds at most one row per ms, so 2**19 rows.
SWEEP_CHUNK_MS = 1 << 19


def periods_and_gaps(df: DataFrame, group: Sequence[str], start_ms: Column, end_ms: Column) -> DataFrame:
    """Continuous covered periods of each group and the gaps between them, by a sweep line.

    Every span becomes a plus event at its start and a minus event at its end.
    Events at one instant are summed first (a map-side aggregate, so copies and
    ties cost nothing and touching spans join), then a running sum over the
    instants counts the open spans. An instant where the count leaves zero opens
    a period, one where it returns to zero closes it; each such border and the
    next one bound either a period or a gap. The sweep is cut into stretches of
    ``SWEEP_CHUNK_MS`` so that a group with most of the rows spreads over tasks.

    Times are integers (ms). Spans with a null time or end <= start are left
    out; a null group key is a group of its own; other columns are ignored.
    Output: *group, kind ('period' or 'gap'), start_ms, end_ms.
    """
    spans = df.select(*group, start_ms.cast("long").alias("__s"), end_ms.cast("long").alias("__e")).filter("__s < __e")
    events = spans.select(*group, F.explode(F.array(F.struct(F.col("__s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("__e").alias("t"), F.lit(-1).alias("d")))).alias("ev"))
    net = events.groupBy(*group, F.col("ev.t").alias("t")).agg(F.sum("ev.d").alias("d")).filter("d <> 0")
    net = net.withColumn("__chunk", F.floor(F.col("t") / SWEEP_CHUNK_MS))
    net = net.repartition(*group, "__chunk")
    swept = running_sum(net, group, "__chunk", [F.col("t")], F.col("d"), "open")
    borders = swept.filter("open = 0 OR open = d").withColumn("kind", F.when(F.col("open") > 0, "period").otherwise("gap"))
    nexts = next_value(borders.select(*group, "__chunk", "t", "kind"), group, "__chunk", [F.col("t")], F.col("t"), "end_ms")
    return nexts.filter("end_ms IS NOT NULL").select(*group, "kind", F.col("t").alias("start_ms"), "end_ms")


def merge_close(df: DataFrame, group: Sequence[str], start: str, end: str, min_gap: float, order: Sequence[str] = ()) -> DataFrame:
    """Merge neighbours of a group whose gap is below ``min_gap`` (strictly), tracking the running end.

    For turns and other short groups: one window per group. A span nested in an
    earlier one joins it. Output: *group, start, end, n_spans. Rows with a null
    or reversed time are left out.
    """
    from pyspark.sql import Window as W

    ok = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    w = W.partitionBy(*group).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ok.withColumn("__new", F.coalesce((F.col(start) - reach >= min_gap).cast("int"), F.lit(1)))
    isl = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isl.groupBy(*group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("__island")


def point_in_span(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bin_width: float, pad: float = 0.0, closed: bool = True) -> DataFrame:
    """Pairs (point, span) with equal keys and the point inside the (padded) span.

    The range condition alone would make a nested-loop join; spans are cut into
    bins of ``bin_width`` and joined with equality on (keys, bin), then checked
    exactly. A span lists every bin it touches, a point exactly one, so no pair
    appears twice. ``bin_width`` near the usual span length keeps both small.
    Null keys or times match nothing.
    """
    lo, hi = F.col(start) - pad, F.col(end) + pad
    binned = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (hi >= lo))
    binned = binned.withColumn("__bin", F.explode(F.sequence(F.floor(lo / bin_width), F.floor(hi / bin_width))))
    p = points.filter(F.col(at).isNotNull()).withColumn("__bin", F.floor(F.col(at) / bin_width))
    inside = (F.col(at) >= lo) & ((F.col(at) <= hi) if closed else (F.col(at) < hi))
    return p.join(binned, [*keys, "__bin"]).filter(inside).drop("__bin")
