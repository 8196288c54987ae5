"""Validation of runs, tables and labels, and reports of several aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenora.functions.text import has_script, is_transient_error, safe_ratio, token_count
from plenora.operators.ledger import upsert


def run_checks(runs: DataFrame, key: str, arm: str, arms: Sequence[str], expected: DataFrame) -> DataFrame:
    """One row of booleans about a run log (key, arm, model, reference, hypothesis, error): ``no_errors``, ``unique``,
    ``not_empty``, ``script`` (half of the hypotheses have letters of the script), ``references``, ``same_keys``
    (the expected keys, all and only), ``paired`` (each key in every arm), ``different_models``."""
    one = runs.agg(
        F.count_if(F.col("error").isNotNull()).alias("e"), F.count_if(F.coalesce(F.trim("hypothesis"), F.lit("")) == "").alias("b"), F.avg(has_script(F.col("hypothesis")).cast("double")).alias("s"),
        F.count_if(F.coalesce(F.trim("reference"), F.lit("")) == "").alias("r"),
    )
    keys = runs.groupBy(key, arm).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("most"), F.countDistinct(F.when(F.col(arm).isin(*arms), F.col(arm))).alias("arms"))
    known = keys.join(expected.select(key, F.lit(True).alias("want")).distinct(), key, "full_outer")
    about = known.agg(F.coalesce(F.max("most") <= 1, F.lit(True)).alias("unique"), (F.count_if(F.col("want").isNull() | F.col("most").isNull()) == 0).alias("same_keys"), F.coalesce(F.bool_and(F.col("most").isNull() | (F.col("arms") == len(arms))), F.lit(True)).alias("paired"))
    models = runs.groupBy("model").agg(F.countDistinct(arm).alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("different_models"))
    flags = one.select((F.col("e") == 0).alias("no_errors"), (F.col("b") == 0).alias("not_empty"), F.coalesce(F.col("s") >= 0.5, F.lit(True)).alias("script"), (F.col("r") == 0).alias("references"))
    return flags.crossJoin(about).crossJoin(models)


def final_checks(runs: DataFrame, index: DataFrame, key: str, arm: str, same: Sequence[str], tolerance: Mapping[str, float], scores: Column) -> DataFrame:
    """(check, offenders, ok) about scored runs against the index they were made from.

    ``coverage``: index keys without a run; ``pending``: keys whose only rows
    are errors; ``one_row``: (key, arm) repeated; ``foreign``: run keys not in
    the index; ``differs_<col>`` for each ``same`` (equal, null equals null) and
    ``tolerance`` column (within eps); ``empty``: rows without a hypothesis;
    ``leak``: references of at least 16 words given back word for word;
    ``scores``: rows for which the condition does not hold.
    """
    mine = runs.withColumn("__ok", F.col("error").isNull())
    idx = index.select(key, *[F.col(c).alias(f"__i_{c}") for c in (*same, *tolerance)], F.lit(True).alias("__in"))
    j = mine.join(idx, key, "left")
    per = mine.groupBy(key).agg(F.bool_or("__ok").alias("done"))
    uncovered = index.select(key).distinct().join(per, key, "left").agg(F.count_if(F.col("done").isNull()).alias("coverage"), F.count_if(~F.col("done")).alias("pending"))
    repeated = mine.groupBy(key, arm).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("one_row"))
    known = F.col("__in").isNotNull()
    bad = {"foreign": ~known} | {f"differs_{c}": known & ~F.col(c).eqNullSafe(F.col(f"__i_{c}")) for c in same} | {f"differs_{c}": known & ~F.coalesce(F.abs(F.col(c) - F.col(f"__i_{c}")) < eps, F.lit(False)) for c, eps in tolerance.items()}
    bad |= {"empty": F.coalesce(F.trim("hypothesis"), F.lit("")) == "", "leak": (token_count(F.col("reference")) >= 16) & (F.col("reference") == F.col("hypothesis")), "scores": ~F.coalesce(scores, F.lit(False))}
    row = j.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad.items()]).crossJoin(uncovered).crossJoin(repeated)
    names = ["coverage", "pending", "one_row", *bad]
    long = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("offenders")) for n in names])).alias("x"))
    return long.select("x.check", "x.offenders", (F.col("x.offenders") == 0).alias("ok"))


def same_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each that the other lacks, as multisets over the columns of ``a``, and whether the tables are equal."""
    cols = a.columns
    left, right = a.select(*cols).exceptAll(b.select(*cols)), b.select(*cols).exceptAll(a.select(*cols))
    return left.agg(F.count(F.lit(1)).alias("only_a")).crossJoin(right.agg(F.count(F.lit(1)).alias("only_b"))).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def pinned(df: DataFrame, constants: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """(constant, found, pinned, ok) of aggregates that must equal what is known of a revision, compared as text."""
    row = df.agg(*[c.cast("string").alias(k) for k, (c, _) in constants.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("constant"), F.col(k).alias("found"), F.lit(str(v)).alias("pinned")) for k, (_, v) in constants.items()])).alias("x")).select("x.*")
    return long.withColumn("ok", F.col("found").eqNullSafe(F.col("pinned")))


def settings_equal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(setting, n_values, ok): whether every row has the same value; null is a value."""
    row = df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("setting"), F.col(c).cast("long").alias("n_values")) for c in cols])).alias("x")).select("x.*")
    return long.withColumn("ok", F.coalesce(F.col("n_values") <= 1, F.lit(True)))


def precision_recall(df: DataFrame, verdict: str, weight: str, by: Mapping[str, str]) -> DataFrame:
    """Precision, recall and error of judged labels, weighted: in all and per value of each grouping (level -> column).

    correct / (correct + cross_person + guest_as_mk) and correct / (correct +
    cross_person + missed); corpus_missed and unjudged rows count in neither.
    One pass over one exploded copy.
    """
    levels = [F.struct(F.lit("ALL").alias("level"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("level"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for k, c in by.items()]]
    each = df.select(verdict, weight, F.explode(F.array(*levels)).alias("x"))
    w = lambda *names: F.coalesce(F.sum(F.when(F.col(verdict).isin(*names), F.col(weight))), F.lit(0))
    sums = each.groupBy("x.level", "x.value").agg(w("correct").alias("correct"), w("cross_person", "guest_as_mk").alias("wrong"), w("cross_person", "missed").alias("lost"))
    return sums.select("level", "value", "correct", "wrong", "lost", safe_ratio(F.col("correct"), F.col("correct") + F.col("wrong")).alias("precision"), safe_ratio(F.col("correct"), F.col("correct") + F.col("lost")).alias("recall"), safe_ratio(F.col("wrong"), F.col("correct") + F.col("wrong")).alias("error"))


def known_errors(labelled: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(check, offenders, ok): assignments that are on the list of known wrong ones."""
    return labelled.join(known.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("offenders")).select(F.lit("known_errors").alias("check"), "offenders", (F.col("offenders") == 0).alias("ok"))


def gate_verdict(flags: DataFrame, flagged: Column, part: str, session: str, most: float = 0.10) -> DataFrame:
    """One row: share of flagged rows, the test and dev sessions among them, and whether the gate lets pass: a share of
    at most ``most`` and no such session."""
    f = F.coalesce(flagged, F.lit(False))
    held = F.array_sort(F.collect_set(F.when(f & F.col(part).isin("test", "dev"), F.col(session))))
    a = flags.agg(F.avg(f.cast("double")).alias("share"), held.alias("sessions"))
    return a.withColumn("passed", F.coalesce(F.col("share") <= most, F.lit(True)) & (F.size("sessions") == 0))


def reconcile_failures(sessions: DataFrame, rows: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Session list (key, error) after a second pass: sessions without rows are errors, those with a transient error
    take the retry's row if there is one, and ``retry`` tells which are still worth one."""
    have = rows.select(key).distinct().withColumn("__rows", F.lit(True))
    marked = sessions.join(have, key, "left").withColumn("error", F.when(F.col("error").isNull() & F.col("__rows").isNull(), "no rows").otherwise(F.col("error"))).drop("__rows")
    again = retried.join(marked.filter(is_transient_error(F.col("error"))).select(key), key, "left_semi")
    return upsert(marked, again.select(*marked.columns), [key]).withColumn("retry", is_transient_error(F.col("error")))


def describe(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """(column, n, mean, sd, min, p25, p50, p75, max) with exact, interpolated quantiles, all columns in one pass."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("e")).select("e.*")
    r = lambda c, n: F.round(c, digits).alias(n)
    q = F.percentile("x", [0.25, 0.5, 0.75])
    stats = each.groupBy("column").agg(F.count("x").alias("n"), r(F.avg("x"), "mean"), r(F.stddev_samp("x"), "sd"), r(F.min("x"), "min"), q.alias("__q"), r(F.max("x"), "max"))
    return stats.select("column", "n", "mean", "sd", "min", *[r(F.col("__q")[i], n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def cross_table(df: DataFrame, row: str, col: str, values: Sequence[str], amount: Column | None = None) -> DataFrame:
    """Rows by columns, one column per listed value and 0 where nothing is; null row keys are left out."""
    v = amount if amount is not None else F.lit(1)
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*[F.coalesce(F.sum(F.when(F.col(col) == x, v)), F.lit(0)).alias(x) for x in values])


def label_sets(df: DataFrame, key: str, label: str, sep: str = "|") -> DataFrame:
    """(key, labels, n_labels): the distinct labels of a key in order, joined."""
    s = df.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("__l"))
    return s.select(key, F.array_join("__l", sep).alias("labels"), F.size("__l").alias("n_labels"))


def report(*sections: tuple[str, DataFrame]) -> DataFrame:
    """(section, line): several result tables as one, each row a JSON line; sections keep their names."""
    parts = [d.select(F.lit(n).alias("section"), F.to_json(F.struct(*d.columns)).alias("line")) for n, d in sections]
    return reduce(lambda a, b: a.unionByName(b), parts)
