"""Error-map queries: two hypotheses per chunk scored by words, pooled per speaker, group and condition.

The corpus tables hold no hypotheses, so two are derived from every chunk's
whole text by positions: arm A replaces and drops words, arm B drops fewer.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.functions.align import edit_counts, error_content, exact_distance, runaway
from plenora.functions.binning import cut, quantile_bins
from plenora.functions.text import blank_to_null, nfkc, normalize_text, to_ms, token_count, tokens
from plenora.operators import metrics, stats
from plenora.operators.ledger import latest_success
from plenora.session import written
from plenora.sources.tables import table

MIN_QUALITY, MIN_CHUNKS = 0.7, 20
ARMS = {"A": "err_a", "B": "err_b"}


def _keep(col: Column, every: int, at: int) -> Column:
    return F.filter(col, lambda t, i: i % every != at)


def scored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """One row per chunk (latest delivery) with reference, hypotheses, word count and error counts."""
    cols = ["speaker_id", "session", "session_date", "knesset", "committee_name", "duration_s", "quality", "text", "gender", "age"]
    rows = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL")
    one = latest_success(rows, ["chunk_id"], F.lit(True), "loaded_at", cols).drop("ok", "loaded_at")
    ref = tokens(normalize_text(nfkc(F.col("text"))))
    a = _keep(F.transform(ref, lambda t, i: F.when(i % 7 == 2, "x").otherwise(t)), 5, 3)
    texts = one.withColumns({"ref": F.array_join(ref, " "), "hyp_a": F.array_join(a, " "), "hyp_b": F.array_join(_keep(ref, 9, 4), " ")})
    counted = texts.withColumns({"words": token_count(F.col("ref")), "err_a": exact_distance(F.col("ref"), F.col("hyp_a")), "err_b": exact_distance(F.col("ref"), F.col("hyp_b")), "ms": to_ms(F.col("duration_s"))})
    return counted.filter("words > 0")


def _compatible() -> str:
    """SQL rows (character, its compatibility form) of all characters that have one, worked out from the Unicode tables."""
    made = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xA0, sys.maxunicode) if unicodedata.decomposition(chr(c)).startswith("<"))
    return ", ".join(f"('{c}', '{d.replace(chr(39), chr(39) * 2)}')" for c, d in made)


#: Texts of all chunks in compatibility form, composed: nf(chunk_id, text).
NFKC = """
WITH compat(c, d) AS (VALUES """ + _compatible() + """),
chars AS (SELECT t, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT DISTINCT text AS t FROM chunk_index WHERE text <> '')),
nf AS (SELECT t AS raw, nfc_normalize(string_agg(coalesce(d, chars.c), '' ORDER BY i)) AS form FROM chars LEFT JOIN compat ON chars.c = compat.c GROUP BY t),
"""
SCORED = (
    NFKC
    + """
one AS (
  SELECT chunk_id, arg_max(struct_pack(speaker_id, session, session_date, knesset, committee_name, duration_s, quality, text, gender, age), loaded_at) AS v
  FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
flat AS (SELECT * REPLACE (form AS text) FROM (SELECT chunk_id, unnest(v) FROM one) LEFT JOIN nf ON raw = text),
toks AS (
  SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{0591}-\\x{05C7}]', '', 'g'), '[^\\p{L}\\p{M}\\p{N}_]+|_+', ' ', 'g')), ' '), lambda t: t <> '') AS r FROM flat),
arms AS (
  SELECT *, list_filter(list_transform(r, lambda t, i: CASE WHEN (i - 1) % 7 = 2 THEN 'x' ELSE t END), lambda t, i: (i - 1) % 5 <> 3) AS a,
         list_filter(r, lambda t, i: (i - 1) % 9 <> 4) AS b FROM toks),
coded AS (SELECT *, list_concat(r, ['x']) AS v FROM arms),
scored AS (
  SELECT chunk_id, speaker_id, session, session_date, knesset, committee_name, duration_s, quality, gender, age, len(r) AS words,
         levenshtein(list_aggregate(list_transform(r, lambda t: chr(CAST(32 + list_position(v, t) AS INT))), 'string_agg', ''), coalesce(list_aggregate(list_transform(a, lambda t: chr(CAST(32 + list_position(v, t) AS INT))), 'string_agg', ''), '')) AS err_a,
         levenshtein(list_aggregate(list_transform(r, lambda t: chr(CAST(32 + list_position(v, t) AS INT))), 'string_agg', ''), coalesce(list_aggregate(list_transform(b, lambda t: chr(CAST(32 + list_position(v, t) AS INT))), 'string_agg', ''), '')) AS err_b,
         CAST(round_even(duration_s * 1000, 0) AS BIGINT) AS ms, array_to_string(r, ' ') AS ref
  FROM coded WHERE len(r) > 0)
"""
)
_POOL = "count(*) AS chunks, sum(words) AS words, sum(err_a) AS err_A, sum(err_b) AS err_B, sum(err_a) / nullif(sum(words), 0) AS rate_A, sum(err_b) / nullif(sum(words), 0) AS rate_B"


def per_speaker_error_map(spark: SparkSession, root: str) -> DataFrame:
    """Pooled rates and gain of every speaker over chunks of sufficient quality, with a reliability flag."""
    kept = scored_chunks(spark, root).filter(F.col("quality") >= MIN_QUALITY)
    extra = [F.countDistinct("session").alias("sessions"), F.sum("ms").alias("ms")]
    t = metrics.with_gain(metrics.pooled_rates(kept, ["speaker_id"], "words", ARMS, extra), "rate_A", "rate_B")
    return t.withColumn("reliable", F.col("chunks") >= MIN_CHUNKS)


def qc_effect(spark: SparkSession, root: str) -> DataFrame:
    """Rates before and after the quality filter and of what it drops."""
    return metrics.threshold_effect(scored_chunks(spark, root), F.col("quality") >= MIN_QUALITY, "words", ARMS)


def rates_by_duration(spark: SparkSession, root: str) -> DataFrame:
    """Pooled rates by right-closed bins of chunk length."""
    rows = scored_chunks(spark, root).withColumn("bin", cut(F.col("duration_s"), [0, 3, 6, 10, 20, 31]))
    return metrics.pooled_rates(rows, ["bin"], "words", ARMS)


def speaker_attributes(spark: SparkSession, root: str) -> DataFrame:
    """One row per speaker: totals, corpus hours, roster attributes with defaults, age quartile, rate tertile."""
    s = scored_chunks(spark, root).filter("speaker_id > 0")
    # One row per speaker, read three times: for itself and for the edges of two binnings.
    per = written(s.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("words").alias("words"), F.sum("err_a").alias("err_a"), F.sum("err_b").alias("err_b"), (F.sum("ms") / 3600000).alias("hours"), (F.floor(F.sum(F.bround(F.col("age") * 100).cast("long")) * 100 / F.count("age")) / 10000).alias("age"), F.round(F.percentile(F.col("words") * 60000 / F.col("ms"), 0.5), 6).alias("wpm")))
    kinds = {"religion": "Unknown", "nationality": "Unknown", "religious_orientation": "Unrecorded", "place_of_birth": "Unknown"}
    code = F.when(F.col("gender") == 1, "Male").when(F.col("gender") == 0, "Female").otherwise("Unknown")
    people = table(spark, root, "mk_metadata").select(F.col("person_id").alias("speaker_id"), code.alias("gender"), *[F.coalesce(blank_to_null(F.col(c)), F.lit(d)).alias(c) for c, d in kinds.items()])
    known = per.join(people, "speaker_id", "left").fillna({"gender": "Unknown"} | kinds)
    banded = quantile_bins(known, "age", ["Q1", "Q2", "Q3", "Q4"], "age_band")
    return quantile_bins(banded, "wpm", ["slow", "medium", "fast"], "rate_band")


RULES = {"gender": "gender", "religion": "religion", "nationality": "nationality", "orientation": "religious_orientation", "origin": "place_of_birth", "age": "age_band", "rate": "rate_band"}
ATTRIBUTES = (
    SCORED
    + """, per AS (
  SELECT speaker_id, count(*) AS chunks, sum(words) AS words, sum(err_a) AS err_a, sum(err_b) AS err_b, sum(ms) / 3600000 AS hours, floor(sum(CAST(round_even(age * 100, 0) AS BIGINT)) * 100 / nullif(count(age), 0)) / 10000 AS age, round(quantile_cont(words * 60000 / ms, 0.5), 6) AS wpm
  FROM scored WHERE speaker_id > 0 GROUP BY speaker_id),
people AS (
  SELECT person_id AS speaker_id, CASE gender WHEN 1 THEN 'Male' WHEN 0 THEN 'Female' ELSE 'Unknown' END AS gender,
"""
    + ",\n".join(f"  CASE WHEN trim({c}) NOT IN ('', 'nan', 'None', '<NA>') THEN trim({c}) END AS {c}" for c in ("religion", "nationality", "religious_orientation", "place_of_birth"))
    + """ FROM mk_metadata),
edges AS (SELECT quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]) AS qa, quantile_cont(wpm, [0, 1/3, 2/3, 1]) AS qw FROM per),
attrs AS (
  SELECT per.*, coalesce(gender, 'Unknown') AS gender, coalesce(religion, 'Unknown') AS religion, coalesce(nationality, 'Unknown') AS nationality, coalesce(religious_orientation, 'Unrecorded') AS religious_orientation,
         coalesce(place_of_birth, 'Unknown') AS place_of_birth,
         CASE WHEN age <= qa[2] THEN 'Q1' WHEN age <= qa[3] THEN 'Q2' WHEN age <= qa[4] THEN 'Q3' WHEN age IS NOT NULL THEN 'Q4' END AS age_band,
         CASE WHEN wpm <= qw[2] THEN 'slow' WHEN wpm <= qw[3] THEN 'medium' WHEN wpm IS NOT NULL THEN 'fast' END AS rate_band
  FROM per LEFT JOIN people USING (speaker_id) CROSS JOIN edges)
"""
)


def subgroup_viability(spark: SparkSession, root: str) -> DataFrame:
    """Every rule's groups with pooled rates, hours with and without the largest member, and viability."""
    t = metrics.subgroups(speaker_attributes(spark, root), RULES, "hours", "words", ARMS, min_hours=0.05)
    return t.withColumns({"hours": F.round("hours", 6), "hours_minus_largest": F.round("hours_minus_largest", 6)})


_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {c} AS grp, speaker_id, words, err_a, err_b, hours FROM attrs" for r, c in RULES.items()) + ")\n"


def speaker_bands(spark: SparkSession, root: str) -> DataFrame:
    """Age quartile and speaking-rate tertile of every speaker, by exact edges."""
    return speaker_attributes(spark, root).select("speaker_id", "age", "wpm", "age_band", "rate_band")


def volume_table(spark: SparkSession, root: str) -> DataFrame:
    """Median and spread of speakers' rates by how many chunks they have."""
    s = metrics.pooled_rates(scored_chunks(spark, root), ["speaker_id"], "words", ARMS)
    b = s.withColumn("bucket", cut(F.col("chunks"), [0, 5, 20, 50, 150, 400, 10**9], ["1-5", "6-20", "21-50", "51-150", "151-400", "400+"]))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("speakers"), F.round(F.percentile("rate_A", 0.5), 9).alias("median_A"), F.round(F.stddev_samp("rate_A"), 9).alias("sd_A"), F.round(F.percentile("rate_B", 0.5), 9).alias("median_B"), F.round(F.stddev_samp("rate_B"), 9).alias("sd_B"))


def chunk_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Quartiles of the chunks' own rates and shares of perfect and failed chunks."""
    s = scored_chunks(spark, root).withColumn("ra", F.col("err_a") / F.col("words")).withColumn("rb", F.col("err_b") / F.col("words"))
    q = [F.round(F.percentile(F.col(c), p), 9).alias(f"{c}_p{int(p * 100)}") for c in ("ra", "rb") for p in (0.25, 0.5, 0.75, 0.9)]
    sh = lambda c, n: F.round(metrics.share(c), 9).alias(n)
    return s.agg(*q, sh(F.col("err_a") == 0, "perfect_A"), sh(F.col("err_b") == 0, "perfect_B"), sh(F.col("ra") >= 1, "fail_A"), sh((F.col("ra") >= 1) & (F.col("rb") >= 1), "fail_both"))


def error_correlation(spark: SparkSession, root: str) -> DataFrame:
    """Spearman correlation of the two arms' error counts, per legislature."""
    return stats.spearman(scored_chunks(spark, root).filter("knesset IS NOT NULL"), ["knesset"], "err_a", "err_b", "rho", 7)


def split_half_reliability(spark: SparkSession, root: str) -> DataFrame:
    """Split-half reliability of the speakers' rates, for either arm."""
    c = scored_chunks(spark, root).filter("speaker_id > 0").select("speaker_id", "session", "words", "err_a", "err_b")
    halves = [stats.split_half(c, "speaker_id", "session", "words", e, 200, 7).withColumn("arm", F.lit(a)) for a, e in ARMS.items()]
    return halves[0].unionByName(halves[1])


def bootstrap_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of both pooled rates and their difference per legislature, 1,000 replicates."""
    s = scored_chunks(spark, root).filter("knesset IS NOT NULL").select("knesset", "chunk_id", "words", "err_a", "err_b")
    w = F.col("words")
    return stats.ratio_intervals(s, "knesset", ["chunk_id"], {"rate_A": (F.col("err_a"), w), "rate_B": (F.col("err_b"), w), "gain": (F.col("err_a") - F.col("err_b"), w)}, ["words", "err_a", "err_b"], 1000, "boot")


def paired_test(spark: SparkSession, root: str) -> DataFrame:
    """Paired bootstrap of the two arms per legislature, 2,000 replicates."""
    s = written(scored_chunks(spark, root).filter("knesset IS NOT NULL").select("knesset", "chunk_id", "words", "err_a", "err_b"))
    return stats.paired_bootstrap(s, "knesset", ["chunk_id"], "err_a", "err_b", "words", 2000, "paired")


def signed_rank_test(spark: SparkSession, root: str) -> DataFrame:
    """Wilcoxon signed-rank p of the two arms per legislature."""
    return stats.wilcoxon(written(scored_chunks(spark, root).filter("knesset IS NOT NULL").select("knesset", "err_a", "err_b")), "knesset", "err_a", "err_b")


def rule_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Share of variance in the speakers' gain and in their rate that each rule explains, with a null of 2,000 permutations."""
    a = speaker_attributes(spark, root).withColumn("gain", F.round((F.col("err_a") - F.col("err_b")) / F.col("words"), 6)).withColumn("rate", F.round(F.col("err_a") / F.col("words"), 6))
    return stats.permutation_rank(written(a.select("speaker_id", "gain", "rate", *RULES.values())), RULES, "speaker_id", ["gain", "rate"])


def flagged_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of at least five chunks whose two rates both exceed 0.9, with first speaker and date and median quality."""
    more = [F.min("speaker_id").alias("first_speaker"), F.min("session_date").alias("date"), F.round(F.percentile("quality", 0.5), 9).alias("quality")]
    return stats.flagged_groups(scored_chunks(spark, root), "session", "words", ["err_a", "err_b"], more=more)


def hard_sessions(spark: SparkSession, root: str) -> DataFrame:
    """As flagged_sessions, at the least bound that some of these texts' made-up arms exceed."""
    more = [F.min("speaker_id").alias("first_speaker"), F.min("session_date").alias("date"), F.round(F.percentile("quality", 0.5), 9).alias("quality")]
    return stats.flagged_groups(scored_chunks(spark, root), "session", "words", ["err_a", "err_b"], 5, 0.08, more)


def adaptation_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Reliable speakers in the order of their relative gain, with average-tie percentile rank."""
    from plenora.operators.sequence import average_rank

    t = per_speaker_error_map(spark, root).filter("reliable AND speaker_id > 0").withColumn("gain_rel", F.round("gain_rel", 9))
    r = average_rank(t, [], "gain_rel", "rank").crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("n"))))
    return r.select("speaker_id", "gain_rel", F.round(F.col("rank") / F.col("n"), 9).alias("rank_pct"))


def edit_operations(spark: SparkSession, root: str) -> DataFrame:
    """Counted substitutions, deletions and insertions of both arms."""
    s = scored_chunks(spark, root)
    long = s.select("ref", F.explode(F.array(F.struct(F.lit("A").alias("arm"), F.col("hyp_a").alias("h")), F.struct(F.lit("B").alias("arm"), F.col("hyp_b").alias("h")))).alias("x")).select("x.arm", "ref", "x.h")
    return error_content(long, "arm", "ref", "h")


def edit_totals(spark: SparkSession, root: str) -> DataFrame:
    """Substitutions, deletions and insertions of arm A by the back-trace, beside the native distance, and the runaway share, per legislature."""
    s = scored_chunks(spark, root).filter("knesset IS NOT NULL").withColumn("c", edit_counts(F.col("ref"), F.col("hyp_a")))
    sums = [F.sum(F.col(f"c.{k}")).alias(k) for k in ("S", "D", "I")]
    return s.groupBy("knesset").agg(F.count(F.lit(1)).alias("chunks"), F.sum("err_a").alias("distance"), *sums, F.count_if(F.col("c.werr") != F.col("err_a")).alias("differ"), F.count_if(runaway(F.col("c.n_words"), F.col("c.hyp_words"))).alias("runaways"))


_POISSON = " + ".join(f"(u >= {t})::INT" for t in stats.POISSON)
_SUMS = """, blocks AS (SELECT knesset, words, err_a, err_b, q, md5('{seed}|' || chunk_id || '|' || q) AS m FROM scored CROSS JOIN (SELECT unnest(range({blocks})) AS q) WHERE knesset IS NOT NULL),
draws AS (SELECT knesset, words, err_a, err_b, q * 8 + j AS b, CAST('0x' || substr(m, 4 * j + 1, 4) AS INT) AS u FROM blocks CROSS JOIN (SELECT unnest(range(8))::INT AS j)),
sums AS (SELECT knesset, b, sum(words * k) AS w, sum(err_a * k) AS ea, sum(err_b * k) AS eb FROM (SELECT *, """ + _POISSON + """ AS k FROM draws) GROUP BY ALL)
"""

QUERIES = {
    f.__name__: f
    for f in (
        per_speaker_error_map, qc_effect, rates_by_duration, subgroup_viability, speaker_bands, volume_table, chunk_distribution, error_correlation, split_half_reliability, bootstrap_intervals,
        paired_test, signed_rank_test, rule_ranking, flagged_sessions, hard_sessions, adaptation_candidates, edit_operations, edit_totals,
    )
}
SQL = {
    "per_speaker_error_map": SCORED + f", g AS (SELECT speaker_id, {_POOL}, count(DISTINCT session) AS sessions, sum(ms) AS ms FROM scored WHERE quality >= 0.7 AND speaker_id IS NOT NULL GROUP BY speaker_id) SELECT *, rate_A - rate_B AS gain_abs, (rate_A - rate_B) / nullif(rate_A, 0) AS gain_rel, chunks >= 20 AS reliable FROM g",
    "qc_effect": SCORED + f"SELECT 'before' AS side, {_POOL} FROM scored UNION ALL SELECT CASE WHEN coalesce(quality >= 0.7, false) THEN 'after' ELSE 'dropped' END, {_POOL} FROM scored GROUP BY 1",
    "rates_by_duration": SCORED + f", b AS (SELECT *, CASE WHEN duration_s < 0 OR duration_s > 31 THEN NULL WHEN duration_s <= 3 THEN '(0, 3]' WHEN duration_s <= 6 THEN '(3, 6]' WHEN duration_s <= 10 THEN '(6, 10]' WHEN duration_s <= 20 THEN '(10, 20]' WHEN duration_s <= 31 THEN '(20, 31]' END AS bin FROM scored) SELECT bin, {_POOL} FROM b WHERE bin IS NOT NULL GROUP BY bin",
    "subgroup_viability": ATTRIBUTES + _LONG + "SELECT rule, grp, count(*) AS members, sum(words) AS words, sum(err_a) AS err_A, sum(err_b) AS err_B, round(sum(hours), 6) AS hours, round(sum(hours) - max(hours), 6) AS hours_minus_largest, sum(err_a) / nullif(sum(words), 0) AS rate_A, sum(err_b) / nullif(sum(words), 0) AS rate_B, count(*) >= 3 AND sum(hours) - max(hours) >= 0.05 AND grp NOT IN ('Unknown', 'Unrecorded') AS viable FROM long WHERE grp IS NOT NULL GROUP BY rule, grp",
    "speaker_bands": ATTRIBUTES + "SELECT speaker_id, age, wpm, age_band, rate_band FROM attrs",
    "volume_table": SCORED + f", g AS (SELECT speaker_id, {_POOL} FROM scored WHERE speaker_id IS NOT NULL GROUP BY 1), b AS (SELECT *, CASE WHEN chunks <= 5 THEN '1-5' WHEN chunks <= 20 THEN '6-20' WHEN chunks <= 50 THEN '21-50' WHEN chunks <= 150 THEN '51-150' WHEN chunks <= 400 THEN '151-400' ELSE '400+' END AS bucket FROM g) SELECT bucket, count(*) AS speakers, round(quantile_cont(rate_A, 0.5), 9) AS median_A, round(stddev_samp(rate_A), 9) AS sd_A, round(quantile_cont(rate_B, 0.5), 9) AS median_B, round(stddev_samp(rate_B), 9) AS sd_B FROM b GROUP BY bucket",
    "chunk_distribution": SCORED + ", r AS (SELECT err_a, err_b, err_a / words AS ra, err_b / words AS rb FROM scored) SELECT " + ", ".join(f"round(quantile_cont({c}, {p}), 9) AS {c}_p{int(p * 100)}" for c in ("ra", "rb") for p in (0.25, 0.5, 0.75, 0.9)) + ", round(avg((err_a = 0)::INT), 9) AS perfect_A, round(avg((err_b = 0)::INT), 9) AS perfect_B, round(avg((ra >= 1)::INT), 9) AS fail_A, round(avg((ra >= 1 AND rb >= 1)::INT), 9) AS fail_both FROM r",
    "error_correlation": SCORED + ", r AS (SELECT knesset, rank() OVER (PARTITION BY knesset ORDER BY err_a) + (count(*) OVER (PARTITION BY knesset, err_a) - 1) / 2 AS x, rank() OVER (PARTITION BY knesset ORDER BY err_b) + (count(*) OVER (PARTITION BY knesset, err_b) - 1) / 2 AS y FROM scored WHERE knesset IS NOT NULL) SELECT knesset, count(*) AS n, round(corr(x, y), 7) AS rho FROM r GROUP BY knesset",
    "split_half_reliability": SCORED + ", per AS (SELECT arm, speaker_id, session, sum(words) AS w, sum(e) AS e, (row_number() OVER (PARTITION BY arm, speaker_id ORDER BY session) - 1) % 2 AS h FROM (SELECT 'A' AS arm, speaker_id, session, words, err_a AS e FROM scored UNION ALL SELECT 'B', speaker_id, session, words, err_b FROM scored) WHERE speaker_id > 0 AND session IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT arm, speaker_id, sum(e) FILTER (h = 0) / sum(w) FILTER (h = 0) AS r0, sum(e) FILTER (h = 1) / sum(w) FILTER (h = 1) AS r1 FROM per GROUP BY 1, 2 HAVING sum(w) FILTER (h = 0) >= 200 AND sum(w) FILTER (h = 1) >= 200), r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY r0) + (count(*) OVER (PARTITION BY arm, r0) - 1) / 2 AS x, rank() OVER (PARTITION BY arm ORDER BY r1) + (count(*) OVER (PARTITION BY arm, r1) - 1) / 2 AS y FROM s), c AS (SELECT arms.arm, count(x) AS speakers, round(CASE WHEN count(x) > 1 THEN corr(x, y) END, 7) AS rho FROM (VALUES ('A'), ('B')) arms(arm) LEFT JOIN r ON r.arm = arms.arm GROUP BY arms.arm) SELECT arm, speakers, rho, round(2 * rho / (1 + rho), 7) AS reliability FROM c",
    "bootstrap_intervals": SCORED + _SUMS.format(seed="boot", blocks=125) + "SELECT knesset, " + ", ".join(f"round(quantile_cont({e} / w, {q}), 9) AS {n}_{t}" for e, n in (("ea", "rate_A"), ("eb", "rate_B"), ("(ea - eb)", "gain")) for q, t in ((0.025, "lo"), (0.975, "hi"))) + " FROM sums GROUP BY knesset",
    "paired_test": SCORED + _SUMS.format(seed="paired", blocks=250) + ", p AS (SELECT knesset, round(sum(err_a - err_b) / sum(words), 9) AS delta, round(sum(err_a - err_b) / nullif(sum(err_a), 0), 9) AS delta_rel FROM scored WHERE knesset IS NOT NULL GROUP BY knesset), d AS (SELECT knesset, (ea - eb) / w AS d FROM sums) SELECT p.*, round(quantile_cont(d, 0.025), 9) AS ci_lo, round(quantile_cont(d, 0.975), 9) AS ci_hi, least(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1.0) AS p_boot FROM p JOIN d USING (knesset) GROUP BY ALL",
    "signed_rank_test": SCORED + """, d AS (SELECT knesset, err_a - err_b AS d, abs(err_a - err_b) AS m FROM scored WHERE knesset IS NOT NULL AND err_a <> err_b),
r AS (SELECT *, rank() OVER (PARTITION BY knesset ORDER BY m) + (count(*) OVER (PARTITION BY knesset, m) - 1) / 2 AS r FROM d),
t AS (SELECT knesset, sum(t * t * t - t) AS ties FROM (SELECT knesset, count(*) AS t FROM d GROUP BY knesset, m) GROUP BY knesset),
z AS (SELECT r.knesset, abs((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - max(ties) / 48)) AS z FROM r JOIN t ON r.knesset = t.knesset GROUP BY r.knesset),
p AS (SELECT knesset, CASE WHEN z > 8 THEN 0 ELSE 1 - 2 * (SELECT sum(exp(-x * x / 2)) FROM (SELECT (i + 0.5) * z / 20000 AS x FROM range(20000) t(i))) * z / 20000 / sqrt(2 * pi()) END AS p FROM z)
SELECT k.knesset, round(coalesce(p, 1.0), 9) AS p_wilcoxon FROM (SELECT DISTINCT knesset FROM scored WHERE knesset IS NOT NULL) k LEFT JOIN p ON k.knesset = p.knesset""",
    "rule_ranking": ATTRIBUTES + _LONG + """, v AS (SELECT l.rule, l.grp, CAST(l.speaker_id AS VARCHAR) AS k, outcome, y, count(*) OVER (PARTITION BY l.rule, l.grp, outcome) AS n FROM long l JOIN (
  SELECT speaker_id, 'gain' AS outcome, round((err_a - err_b) / words, 6) AS y FROM attrs UNION ALL SELECT speaker_id, 'rate', round(err_a / words, 6) FROM attrs) o ON l.speaker_id = o.speaker_id WHERE grp IS NOT NULL AND grp NOT IN ('Unknown', 'Unrecorded')),
ok AS (SELECT * FROM v WHERE n >= 3),
obs AS (SELECT rule, outcome, count(DISTINCT grp) AS groups, count(*) AS n, sum(y) AS t1, sum(y * y) AS t2 FROM ok GROUP BY ALL),
ob AS (SELECT rule, outcome, sum(gs * gs / gn) AS btw FROM (SELECT rule, outcome, grp, sum(y) AS gs, count(*) AS gn FROM ok GROUP BY ALL) GROUP BY ALL),
o AS (SELECT rule, outcome, groups, n, t1, t2, round((btw - t1 * t1 / n) / nullif(t2 - t1 * t1 / n, 0), 7) AS eta2 FROM obs JOIN ob USING (rule, outcome)),
h AS (SELECT k, b, md5('perm|' || b || '|' || k) AS h FROM (SELECT DISTINCT k FROM ok) CROSS JOIN (SELECT unnest(range(2000)) AS b)),
l AS (SELECT rule, outcome, grp, row_number() OVER (PARTITION BY rule, outcome ORDER BY k) AS i FROM ok),
x AS (SELECT rule, outcome, b, y, row_number() OVER (PARTITION BY rule, outcome, b ORDER BY h) AS i FROM ok JOIN h USING (k)),
nb AS (SELECT rule, outcome, b, sum(gs * gs / gn) AS btw FROM (SELECT l.rule, l.outcome, b, grp, sum(y) AS gs, count(*) AS gn FROM x JOIN l ON x.rule = l.rule AND x.outcome = l.outcome AND x.i = l.i GROUP BY ALL) GROUP BY ALL),
e AS (SELECT o.rule, o.outcome, round((btw - t1 * t1 / n) / nullif(t2 - t1 * t1 / n, 0), 7) AS e, eta2 FROM nb JOIN o ON nb.rule = o.rule AND nb.outcome = o.outcome),
p AS (SELECT rule, outcome, round(quantile_cont(e, 0.95), 7) AS null95, round(avg((e >= eta2)::INT), 7) AS p FROM e GROUP BY ALL)
SELECT o.rule, o.outcome, groups, n, eta2, null95, p, p < 0.05 AS flag FROM o JOIN p ON o.rule = p.rule AND o.outcome = p.outcome""",
    **{n: SCORED + f"SELECT session, count(*) AS chunks, sum(words) AS words, sum(err_a) AS err_a, sum(err_b) AS err_b, min(speaker_id) AS first_speaker, min(session_date) AS date, round(quantile_cont(quality, 0.5), 9) AS quality FROM scored WHERE session IS NOT NULL GROUP BY session HAVING count(*) >= 5 AND sum(err_a) / sum(words) > {b} AND sum(err_b) / sum(words) > {b}" for n, b in (("flagged_sessions", 0.9), ("hard_sessions", 0.08))},
    "adaptation_candidates": SCORED + f", g AS (SELECT speaker_id, {_POOL} FROM scored WHERE quality >= 0.7 AND speaker_id > 0 GROUP BY 1 HAVING count(*) >= 20), r AS (SELECT speaker_id, round((rate_A - rate_B) / nullif(rate_A, 0), 9) AS gain_rel FROM g) SELECT speaker_id, gain_rel, round((rank() OVER (ORDER BY gain_rel) + (count(*) OVER (PARTITION BY gain_rel) - 1) / 2) / count(*) OVER (), 9) AS rank_pct FROM r",
    # Arm A is made of substitutions and deletions only, so their numbers follow from the places; the alignment does not know them.
    "edit_totals": SCORED + ", n AS (SELECT knesset, words, err_a, len(list_filter(range(words), lambda i: i % 5 = 3)) AS d, len(list_filter(range(words), lambda i: i % 7 = 2 AND i % 5 <> 3)) AS s FROM scored WHERE knesset IS NOT NULL) SELECT knesset, count(*) AS chunks, CAST(sum(err_a) AS BIGINT) AS distance, CAST(sum(s) AS BIGINT) AS S, CAST(sum(d) AS BIGINT) AS D, 0 AS I, count(*) FILTER (s + d <> err_a) AS differ, count(*) FILTER (words - d > 3 * greatest(words, 1)) AS runaways FROM n GROUP BY knesset",
}
