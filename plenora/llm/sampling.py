"""Samples that are the same on every run and keep their members as data grows.

Consistent weighted Poisson sampling: a record is selected when the hash of its
identifier, read as a number in [0, 1), is below its weight times a constant.
A record's weight is that of its cohort, the records of one stratum that a
delivery brought: the sample's target over the number of records the stratum
had by then. What a cohort's weight has once been it never falls below: the
running maxima are kept in a table between deliveries, so rows that arrive late
for an old delivery lower nobody's chance, and a selected record stays selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.operators.skew import HOT_LEAST, HOT_SHARE, salted_join
from plenora.session import written


def unit_hash(col: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed|value); exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), col.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cohort_weights(first_seen: DataFrame, stratum: str, batch: str, target: float, state: DataFrame | None = None) -> DataFrame:
    """The state after a delivery: stratum, batch, n (records of the cohort), weight (its running maximum).

    ``first_seen`` has one row per record known so far, with its stratum and
    first batch; ``state`` is this function's result after an earlier delivery.
    A cohort's weight is min(1, target / records of the stratum up to the
    cohort's batch), or what ``state`` holds for it if that is more. A null
    stratum is a stratum of its own; cohorts that only ``state`` has are kept.
    """
    now = first_seen.groupBy(stratum, batch).agg(F.count(F.lit(1)).alias("n"))
    seen = F.sum("n").over(W.partitionBy(stratum).orderBy(batch).rowsBetween(W.unboundedPreceding, 0))
    fresh = now.withColumn("weight", F.least(F.lit(1.0), F.lit(float(target)) / seen))
    if state is None:
        return fresh
    both = fresh.unionByName(state.select(stratum, batch, "n", "weight"))
    return both.groupBy(stratum, batch).agg(F.max("n").alias("n"), F.max("weight").alias("weight"))


def first_seen(df: DataFrame, id_col: str, stratum: str, batch: str) -> DataFrame:
    """(id, stratum, first_batch) of every id: its first batch and the stratum it had there, the smallest if it had several.
    Rows with a null id or batch are left out: nothing would identify them in a later run."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(batch).isNotNull())
    return rows.groupBy(id_col).agg(F.min(F.struct(F.col(batch).alias("b"), F.col(stratum).alias("s"))).alias("f")).select(id_col, F.col("f.s").alias(stratum), F.col("f.b").alias("first_batch"))


def consistent_sample(df: DataFrame, id_col: str, stratum: str, batch: str, target: float, constant: float = 1.0, seed: str = "sample", state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, state) of all records delivered so far; ``state`` is the table to hand in again after the next delivery.

    A record delivered again counts once, at its first batch. The state is
    written to the shared folder and the sample is read off it. Expected size of
    a stratum of n records: min(n, target) while it arrives in one delivery, and
    at most target * (1 + ln(n / target)) however it arrives, as members never
    leave. Sample: id, stratum, first_batch, weight.
    """
    first = first_seen(df, id_col, stratum, batch)
    weights = written(cohort_weights(first, stratum, "first_batch", target, state))
    per = weights.groupBy(F.col(stratum).alias("__s")).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("first_batch", "weight"))).alias("weights"))
    # A stratum has one row here, with as many weights as there were deliveries. The null stratum gets a key of its own.
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    keyed = per.select(name("__s").alias("__k"), "n", "weights")
    total = weights.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in keyed.filter(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE)).select("__k").collect()]
    met = salted_join(first.withColumn("__k", name(stratum)), keyed.select("__k", "weights"), "__k", hot, [id_col])
    weight = F.element_at("weights", F.col("first_batch"))
    picked = met.withColumn("weight", weight).filter(unit_hash(F.col(id_col), seed) < F.col("weight") * constant)
    return picked.select(id_col, stratum, "first_batch", "weight"), weights
