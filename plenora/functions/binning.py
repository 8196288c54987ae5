"""Right-closed binning by given edges and by exact quantiles, and weighted medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(col: Column, edges: Sequence[float], labels: Sequence[str] | None = None, include_lowest: bool = True) -> Column:
    """Label of the right-closed bin (lo, hi] that holds the value; null outside all bins and for null or NaN.

    ``Bucketizer`` closes bins on the left and is no substitute.
    """
    out = F.lit(None).cast("string")
    for k in reversed(range(len(edges) - 1)):
        lo, hi = edges[k], edges[k + 1]
        above = (col >= lo) if include_lowest and k == 0 else (col > lo)
        out = F.when(above & (col <= hi), labels[k] if labels else f"({lo:g}, {hi:g}]").otherwise(out)
    return out


def quantile_bins(df: DataFrame, col: str, labels: Sequence[str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the label of the quantile bin of ``col`` (exact edges, linear interpolation, right-closed).

    Edges come from one aggregate per ``keys`` group and are joined back, so a
    group's rows are never gathered. Null values get no label.
    """
    q = [k / len(labels) for k in range(len(labels) + 1)]
    edges = df.groupBy(*keys).agg(F.percentile(F.col(col), q).alias("__e"))
    both = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    label = F.lit(None).cast("string")
    for k in reversed(range(len(labels))):
        lo, hi = F.col("__e")[k], F.col("__e")[k + 1]
        above = (F.col(col) >= lo) if k == 0 else (F.col(col) > lo)
        label = F.when(above & (F.col(col) <= hi), labels[k]).otherwise(label)
    return both.withColumn(out, label).drop("__e")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Weighted median per group, interpolated between the midpoints of the weights.

    Values are sorted; each sits at the cumulative weight minus half its own;
    the median is read off at half the total, held constant beyond the ends.
    One value is its own median; a group of total weight 0 gets the plain
    median. Rows with a null value are left out, a null weight counts as 0.
    Rows equal in value and weight are counted first, ties in value go by
    weight, so the result does not depend on the order of rows. Output: *keys, out.
    """
    weight_ = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v"), weight_.alias("__w")).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys).orderBy("__v", "__w")
    mass = F.col("__w") * F.col("__n")
    cum = F.sum(mass).over(w.rowsBetween(W.unboundedPreceding, 0))
    # Equal rows lie between these two points, where the curve is flat.
    placed = rows.withColumn("__hi", cum - F.col("__w") / 2).withColumn("__lo", cum - mass + F.col("__w") / 2).withColumn("__half", F.sum(mass).over(W.partitionBy(*keys)) / 2)
    stepped = placed.withColumn("__pv", F.lag("__v").over(w)).withColumn("__ph", F.lag("__hi").over(w))
    at = (
        F.when((F.col("__half") >= F.col("__lo")) & (F.col("__half") <= F.col("__hi")), F.col("__v"))
        .when((F.col("__half") < F.col("__lo")) & F.col("__pv").isNull(), F.col("__v"))
        .when((F.col("__half") < F.col("__lo")) & (F.col("__half") > F.col("__ph")), F.col("__pv") + (F.col("__v") - F.col("__pv")) * (F.col("__half") - F.col("__ph")) / (F.col("__lo") - F.col("__ph")))
    )
    picked = stepped.withColumn("__at", at)
    plain = F.expr("percentile(__v, 0.5, __n)")
    return picked.groupBy(*keys).agg(F.when(F.max("__half") > 0, F.coalesce(F.min("__at"), F.max("__v"))).otherwise(plain).alias(out))
