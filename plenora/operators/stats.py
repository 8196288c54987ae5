"""Resampling intervals, permutation tests and rank statistics with reproducible draws.

Draws come from md5 of a seed, the replicate and a key: the same on every run,
partitioning and engine. Bootstrap replicates are Poisson: every row counts a
Poisson(1) number of times in each replicate, drawn from its own key alone, so
sums are taken where the rows lie and nothing is joined or numbered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenora.functions.text import safe_ratio
from plenora.operators.metrics import eta_squared
from plenora.operators.sequence import average_rank
from plenora.session import written

#: A 16-bit draw of so much or more counts one time more: the distribution function of Poisson(1).
POISSON = [int(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(8)]


def resampled_sums(df: DataFrame, group: str, order: Sequence[str], cols: Sequence[str], n_boot: int, seed: str = "boot") -> DataFrame:
    """(group, __b, sums of ``cols``) of ``n_boot`` Poisson replicates; ``order`` names the row's key.

    The eight draws of replicates 8 q to 8 q + 7 are the 16-bit parts of
    md5(seed|key|q). One pass: each task multiplies its rows' weights with their
    values and hands on one row per group and replicate. Null values count as 0;
    rows with a null group are left out; rows of one key have the same draws.
    """
    blocks = -(-n_boot // 8)
    kind = df.schema[group].dataType.simpleString()
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("__g"), key.alias("__key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * n_boot, to), pa.array(np.arange(n_boot, dtype=np.int32)), *[pa.array(sums[:, k]) for k in range(len(cols))]], names=["__g", "__b", *cols])
            held.clear()

        to = None
        for b in batches:
            to = b.column(0).type
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                raw = b"".join(hashlib.md5(f"{k}|{q}".encode()).digest() for k in part.column(1).to_pylist() for q in range(blocks))
                draws = np.frombuffer(raw, ">u2").reshape(part.num_rows, blocks * 8)[:, :n_boot]
                weights = np.searchsorted(POISSON, draws.ravel(), "right").reshape(draws.shape).astype(float)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[2:]], axis=1)
                enc = part.column(0).dictionary_encode()
                code = enc.indices.to_numpy(zero_copy_only=False)
                for g, name in enumerate(enc.dictionary.to_pylist()):
                    own = code == g
                    sums = weights[own].T @ values[own]
                    held[name] = held[name] + sums if name in held else sums
            if len(held) * n_boot > 2_000_000:
                yield from out()
        yield from out()

    parts = rows.mapInArrow(work, f"__g {kind}, __b int, " + ", ".join(f"`{c}` double" for c in cols))
    return parts.groupBy("__g", "__b").agg(*[F.sum(c).alias(c) for c in cols]).withColumnRenamed("__g", group)


def ratio_intervals(df: DataFrame, group: str, order: Sequence[str], ratios: Mapping[str, tuple[Column, Column]], cols: Sequence[str], n_boot: int = 1000, seed: str = "boot", digits: int = 9) -> DataFrame:
    """2.5 % and 97.5 % points of pooled ratios (name -> numerator, denominator over the summed ``cols``) per group."""
    sums = resampled_sums(df, group, order, cols, n_boot, seed)
    vals = sums.select(group, *[safe_ratio(n, d).alias(k) for k, (n, d) in ratios.items()])
    aggs = [F.round(F.percentile(F.col(k), q), digits).alias(f"{k}_{tag}") for k in ratios for q, tag in ((0.025, "lo"), (0.975, "hi"))]
    return vals.groupBy(group).agg(*aggs)


def paired_bootstrap(df: DataFrame, group: str, order: Sequence[str], base: str, tuned: str, words: str, n_boot: int = 2000, seed: str = "paired", digits: int = 9) -> DataFrame:
    """Per group the difference of two pooled rates, its relative size, interval and two-sided p."""
    point = df.groupBy(group).agg(F.sum(base).alias("__eb"), F.sum(tuned).alias("__et"), F.sum(words).alias("__w"))
    point = point.select(group, safe_ratio(F.col("__eb") - F.col("__et"), F.col("__w")).alias("delta"), safe_ratio(F.col("__eb") - F.col("__et"), F.col("__eb")).alias("delta_rel"))
    sums = resampled_sums(df, group, order, [base, tuned, words], n_boot, seed).withColumn("__d", safe_ratio(F.col(base) - F.col(tuned), F.col(words)))
    sides = F.least(F.avg((F.col("__d") <= 0).cast("double")), F.avg((F.col("__d") >= 0).cast("double")))
    ci = sums.groupBy(group).agg(F.round(F.percentile("__d", 0.025), digits).alias("ci_lo"), F.round(F.percentile("__d", 0.975), digits).alias("ci_hi"), F.least(2 * sides, F.lit(1.0)).alias("p_boot"))
    return point.join(ci, group).withColumns({c: F.round(c, digits) for c in ("delta", "delta_rel")})


def wilcoxon(df: DataFrame, group: str, a: str, b: str, digits: int = 9) -> DataFrame:
    """Signed-rank p per group by the normal approximation with tie correction; 1.0 without differences.

    Exact small-sample tables are not used; zero differences are left out.
    """
    d = df.select(group, (F.col(a) - F.col(b)).cast("double").alias("d")).withColumn("m", F.abs("d"))
    some = average_rank(d.filter("d <> 0"), [group], "m", "r")
    tie = some.groupBy(group, "m").agg(F.count(F.lit(1)).alias("t")).groupBy(group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = some.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0)
    every = df.select(group).distinct()
    tested = s.join(tie, group).select(group, F.round(two_sided(z), digits).alias("p"))
    return every.join(tested, group, "left").select(group, F.coalesce("p", F.lit(1.0)).alias("p_wilcoxon"))


def two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal deviate, JVM-side: the upper tail by its series near 0 and by its continued
    fraction further out, each to 1e-10 of what it stands for. Null and NaN give null."""
    x = F.abs(z)
    # Folds, not written-out sums: these would outgrow the compiler's limits.
    zero = F.struct(x.alias("term"), x.alias("total"))
    step = lambda acc, k: F.struct((acc["term"] * x * x / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * x * x / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(44)), zero, step, lambda acc: acc["total"])
    dense = F.exp(-x * x / 2) * 0.3989422804014327
    tail = F.aggregate(F.sequence(F.lit(59), F.lit(1), F.lit(-1)), x + 60.0 / x, lambda acc, k: x + k / acc)
    return F.when(~F.isnan(z), F.when(x < 3, 1 - 2 * dense * total).otherwise(2 * dense / tail))


def permutation_rank(df: DataFrame, rules: Mapping[str, str], key: str, values: Sequence[str], n_perm: int = 2000, seed: str = "perm", min_group: int = 3, not_groups: Sequence[str] = ("Unknown", "Unrecorded"), digits: int = 7, block: int = 50) -> DataFrame:
    """One row per (rule, outcome): groups, n, eta2, the null's 95 % point, p = share of permutations at or above eta2, flag p < 0.05.

    Labels of a permutation are the labels in key order set against the rows in
    the order of md5(seed|perm|key). Groups under ``min_group`` members and the
    ``not_groups`` are left out. ``df`` has one row per key (a person); every
    block of permutations is one Arrow group over this table. Values are rounded
    to ``digits`` before they are compared, so that equal ones are equal.
    """
    each = df.select(F.col(key).cast("string").alias("k"), *[F.col(v).cast("double").alias(v) for v in values], F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("string").alias("grp")) for r, c in rules.items()])).alias("x")).select("k", *values, "x.rule", "x.grp")
    known = each.filter(F.col("k").isNotNull() & F.col("grp").isNotNull() & ~F.col("grp").isin(*not_groups))
    for v in values:
        known = known.filter(F.col(v).isNotNull())
    big = known.groupBy("rule", "grp").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_group).drop("__n")
    ok = written(known.join(big, ["rule", "grp"]))
    sizes = ok.groupBy("rule").agg(F.countDistinct("grp").alias("groups"))
    obs = None
    for v in values:
        one = eta_squared(ok, ["rule"], "grp", v).withColumn("outcome", F.lit(v))
        obs = one if obs is None else obs.unionByName(one)
    obs = obs.join(sizes, "rule").withColumn("eta2", F.round("eta2", digits))

    def work(group: tuple, table: pa.Table) -> pa.Table:
        first = group[0].as_py() * block
        rule, k = np.array(table.column("rule").to_pylist()), np.array(table.column("k").to_pylist())
        out: dict[str, list] = {"rule": [], "outcome": [], "e": []}
        names, at = np.unique(k, return_inverse=True)
        parts = []
        for r in np.unique(rule):
            own = np.flatnonzero(rule == r)
            own = own[np.argsort(k[own])]
            label = np.unique(np.array(table.column("grp").to_pylist(), object)[own].astype(str), return_inverse=True)[1]
            parts.append((str(r), own, label, np.bincount(label)))
        cols = {v: table.column(v).to_numpy() for v in values}
        for p in range(first, min(first + block, n_perm)):
            rank = np.empty(len(names), int)
            hi, lo = np.frombuffer(b"".join(hashlib.md5(f"{seed}|{p}|{x}".encode()).digest() for x in names), ">u8").reshape(-1, 2).T
            rank[np.lexsort((lo, hi))] = np.arange(len(names))
            for r, own, label, n in parts:
                order = own[np.argsort(rank[at[own]])]
                for v, y in cols.items():
                    s = np.bincount(label, y[order])
                    mean2, sq = y[own].sum() ** 2 / len(own), (y[own] ** 2).sum()
                    out["rule"].append(r)
                    out["outcome"].append(v)
                    out["e"].append((float((s * s / n).sum()) - mean2) / (sq - mean2) if sq > mean2 else None)
        return pa.table({"rule": pa.array(out["rule"], pa.string()), "outcome": pa.array(out["outcome"], pa.string()), "e": pa.array(out["e"], pa.float64())})

    blocks = ok.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // block) - 1))))
    null = blocks.groupBy("__block").applyInArrow(work, "rule string, outcome string, e double").select("rule", "outcome", F.round("e", digits).alias("e"))
    back = null.join(obs.select("rule", "outcome", F.col("eta2").alias("o")), ["rule", "outcome"])
    p = back.groupBy("rule", "outcome").agg(F.round(F.percentile("e", 0.95), digits).alias("null95"), F.round(F.avg((F.col("e") >= F.col("o")).cast("double")), digits).alias("p"))
    return obs.join(p, ["rule", "outcome"]).select("rule", "outcome", "groups", "n", "eta2", "null95", "p", (F.col("p") < 0.05).alias("flag"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str, digits: int = 9) -> DataFrame:
    """Pearson correlation of average ranks per group; pairs with a null are left out."""
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_rank(average_rank(ok, keys, a, "__ra"), keys, b, "__rb")
    # Ranks are halves of whole numbers: doubled they sum exactly, in any order.
    x, y = (F.col("__ra") * 2).cast("decimal(20,0)"), (F.col("__rb") * 2).cast("decimal(20,0)")
    s = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    d = {c: F.col(c).cast("double") for c in ("x", "y", "xx", "yy", "xy")}
    n = F.col("n").cast("double")
    rho = safe_ratio(n * d["xy"] - d["x"] * d["y"], F.sqrt(n * d["xx"] - d["x"] * d["x"]) * F.sqrt(n * d["yy"] - d["y"] * d["y"]))
    return s.select(*keys, "n", F.round(rho, digits).alias(out))


def split_half(df: DataFrame, speaker: str, session: str, words: str, errors: str, min_words: int = 200, digits: int = 9) -> DataFrame:
    """Split-half reliability of pooled rates: sessions of a speaker alternate between two halves; Spearman
    between halves over speakers with enough words in both, stepped up by 2r / (1 + r)."""
    per = df.filter(F.col(speaker).isNotNull() & F.col(session).isNotNull()).groupBy(speaker, session).agg(F.sum(words).alias("w"), F.sum(errors).alias("e"))
    half = per.withColumn("h", (F.row_number().over(W.partitionBy(speaker).orderBy(session)) - 1) % 2)
    sums = half.groupBy(speaker).agg(*[F.sum(F.when(F.col("h") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("w", "e")])
    ok = sums.filter((F.col("w0") >= min_words) & (F.col("w1") >= min_words)).select(speaker, (F.col("e0") / F.col("w0")).alias("r0"), (F.col("e1") / F.col("w1")).alias("r1"))
    rho = spearman(ok, [], "r0", "r1", "rho", digits)
    return rho.select(F.col("n").alias("speakers"), "rho", F.round(2 * F.col("rho") / (1 + F.col("rho")), digits).alias("reliability"))


def flagged_groups(df: DataFrame, group: str, words: str, errors: Sequence[str], least: int = 5, above: float = 0.9, more: Sequence[Column] = ()) -> DataFrame:
    """Groups of at least ``least`` rows whose pooled rates are all above the bound, with ``more`` aggregates of each."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("chunks"), F.sum(words).alias("words"), *[F.sum(e).alias(e) for e in errors], *more)
    bad = F.col("chunks") >= least
    for e in errors:
        bad = bad & (safe_ratio(F.col(e), F.col("words")) > above)
    return g.filter(F.coalesce(bad, F.lit(False)))


def compared_measures(df: DataFrame, key: str, a: str, b: str, lowest: int = 40, digits: int = 7) -> DataFrame:
    """One row about two variants of a measure: keys, Spearman correlation, and how many of the ``lowest`` keys by one
    (ties by key) are among the lowest by the other. Keys that lack either value are left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    low = [both.orderBy(c, key).limit(lowest).select(key) for c in (a, b)]
    shared = low[0].join(low[1], key).agg(F.count(F.lit(1)).alias("shared_lowest"))
    return spearman(both, [], a, b, "rho", digits).crossJoin(F.broadcast(shared))


def curve_delta(df: DataFrame, key: str, order: Sequence[str], seed_col: str, own: tuple[str, str], control: tuple[str, str], base: str, n_boot: int = 2000, seed: str = "curve", digits: int = 9) -> DataFrame:
    """Change of a personal margin between a reference and a top budget, with an interval.

    ``df`` has one row per (seed, item); ``own`` and ``control`` name the error
    counts at (reference, top), ``base`` those of the base. The margin is
    sum(control - own) / sum(base) per seed, averaged over the seeds; the result
    is top minus reference. All seeds and both budgets share one draw of items.
    """
    per = df.groupBy(key, *order).agg(*[F.sum(c).alias(c) for c in dict.fromkeys((*own, *control))], F.max(base).alias(base), F.countDistinct(seed_col).alias("__seeds"))
    cols = [*dict.fromkeys((*own, *control)), base, "__w"]
    wide = per.withColumn("__w", F.col(base) * F.col("__seeds"))
    margin = lambda k: safe_ratio(F.col(control[k]) - F.col(own[k]), F.col("__w"))
    point = wide.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols]).select(key, F.round(margin(1) - margin(0), digits).alias("delta"))
    sums = resampled_sums(wide, key, [key, *order], cols, n_boot, seed).withColumn("__d", margin(1) - margin(0))
    return point.join(sums.groupBy(key).agg(F.round(F.percentile("__d", 0.025), digits).alias("ci_lo"), F.round(F.percentile("__d", 0.975), digits).alias("ci_hi")), key)
