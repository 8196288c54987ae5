"""Queries on selections, samples and results of adapted models.

The tables hold no training runs; ``_results`` makes a results table of the
counted errors: one row per (arm, budget, seed) with error rates that follow
from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.functions import text as tx
from plenora.functions.align import shared_insertions
from plenora.functions.binning import cut
from plenora.operators import metrics, panel, select, sequence, stats
from plenora.plans.corpus import _CHUNKS, _USABLE, _chunks, _spans
from plenora.plans.runs import _inserted
from plenora.plans.scoring import SCORED, per_speaker_error_map, scored_chunks
from plenora.session import written
from plenora.sources.tables import table
from plenora.streaming import ingest


def _results(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "committees_error_content").select("arm", "kind", (F.col("row_id") % 3).alias("budget"), (F.col("row_id") % 4).alias("seed"), "count")
    return e.groupBy("arm", "kind", "budget", "seed").agg(F.sum("count").alias("errors"))


_RESULTS = "WITH res AS (SELECT arm, kind, row_id % 3 AS budget, row_id % 4 AS seed, CAST(sum(count) AS BIGINT) AS errors FROM committees_error_content GROUP BY ALL)"


def selected_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of quality 0.7 and 5 to 20 seconds that the plan names."""
    ids = table(spark, root, "panel_plan_v2").filter("chunk_id IS NOT NULL")
    return select.select_rows(_chunks(spark, root), "chunk_id", min_quality=0.7, min_s=5.0, max_s=20.0, ids=ids).select("chunk_id", "speaker_id", "session")


def sampled_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Fifty chunks in seeded order: a uniform sample without replacement."""
    return select.seeded_sample(_chunks(spark, root), "chunk_id", 50, 11).select("chunk_id", "speaker_id")


def spread_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Three chunks per speaker in seeded order, of different sessions where there are enough."""
    return select.spread_sample(_chunks(spark, root).select("speaker_id", "session", "chunk_id"), "speaker_id", "session", "chunk_id", 3, 5)


def longest_per_group(spark: SparkSession, root: str) -> DataFrame:
    """The longest chunks of every (legislature, speaker): sixty shared by a legislature's speakers, at least one each."""
    c = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL AND knesset IS NOT NULL AND speaker_id > 0").groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "knesset", "speaker_id", "duration_s")).alias("x")).select("chunk_id", "x.knesset", "x.speaker_id", "x.duration_s")
    return select.quota_of_groups(c, "knesset", "speaker_id", [F.desc("duration_s"), F.asc("chunk_id")], 60).select("knesset", "speaker_id", "chunk_id")


def lowest_overlap(spark: SparkSession, root: str) -> DataFrame:
    """The two arms' rates as variants of one measure over speakers: correlation and shared lowest forty."""
    t = per_speaker_error_map(spark, root).select("speaker_id", F.round("rate_A", 9).alias("a"), F.round("rate_B", 9).alias("b"))
    return stats.compared_measures(written(t), "speaker_id", "a", "b")


def worst_of_largest(spark: SparkSession, root: str) -> DataFrame:
    """Of the thirty speakers with most chunks, by rate."""
    t = per_speaker_error_map(spark, root).orderBy(F.desc("chunks"), "speaker_id").limit(30)
    return t.select("speaker_id", "chunks", F.round("rate_A", 9).alias("rate")).orderBy(F.desc("rate"), "speaker_id")


def word_quality(spark: SparkSession, root: str) -> DataFrame:
    """Per speaker: chunks whose recogniser's words fit the reference, minutes in all and of these, and the kept share."""
    c = scored_chunks(spark, root).filter("speaker_id > 0")
    low = F.col("err_b") / F.col("words")
    ok = select.words_ok(F.size(tx.tokens(F.col("hyp_b"))), F.col("words"), low, F.col("words") % 5)
    return c.withColumn("ok", ok).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("ok").alias("fit"), F.sum("ms").alias("ms"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("ms"))), F.lit(0)).alias("fit_ms"), F.round(metrics.share(F.col("ok")), 9).alias("kept_share"))


def candidate_list(spark: SparkSession, root: str) -> DataFrame:
    """Candidates: each speaker's newest sessions up to a raw minute of speech, of quality 0.8, excluded sessions out."""
    excluded = table(spark, root, "manifest").filter("NOT coalesce(complete, false)").select(F.col("session_id").alias("session"))
    c = select.without(_chunks(spark, root).filter("quality >= 0.8"), excluded, ["session"])
    got = select.candidate_rows(c, "speaker_id", "session", "session_date", F.col("ms"), 60_000)
    return got.groupBy("speaker_id", "session").agg(F.count(F.lit(1)).alias("chunks"), F.sum("ms").alias("ms"))


def quality_bands(spark: SparkSession, root: str) -> DataFrame:
    """Pooled rates by half-open bands of quality."""
    s = scored_chunks(spark, root).withColumn("band", select.band(F.col("quality"), [0.0, 0.7, 0.8, 0.9, 1.01]))
    return metrics.pooled_rates(s, ["band"], "words", {"A": "err_a", "B": "err_b"})


def first_and_deduped(spark: SparkSession, root: str) -> DataFrame:
    """Per session the first speaker (by start, then end and filename) who has an id, and its first name line."""
    s = table(spark, root, "segments").filter("session IS NOT NULL AND filename IS NOT NULL")
    order = [F.coalesce("start", F.lit(1e18)), F.coalesce("end", F.lit(1e18)), F.col("filename"), F.col("ingested_at")]
    return s.groupBy("session").agg(select.first_by(F.when(F.col("speaker_id") > 0, F.col("speaker_id")), *order).alias("first_speaker"), select.first_by(F.col("raw_name"), *order).alias("first_name"))


def hash_parts(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of four parts of the chunks by crc32 of their ids: together all, each its own."""
    c = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL").select("chunk_id").distinct()
    parts = [select.hash_part(c, "chunk_id", 4, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= 0).alias("parts"))


def error_kind_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares of substitutions, deletions and insertions in all errors, per arm."""
    e = table(spark, root, "committees_error_content").groupBy("arm").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k) for k in ("substitution", "deletion", "insertion")])
    t = panel.error_shares(e, {"S": "substitution", "D": "deletion", "I": "insertion"})
    return t.withColumns({k: F.round(k, 9) for k in "SDI"})


def personal_margins(spark: SparkSession, root: str) -> DataFrame:
    """Own gain beside the control's of the same budget or of budget 1, and its share of the base."""
    r = _results(spark, root).groupBy("arm", "kind", "budget").agg(F.sum("errors").alias("delta"))
    own = r.filter("arm = 'A'").drop("arm").withColumn("base", F.col("delta") * 2 + 1)
    t = panel.personal_margins(own, r.filter("arm = 'B' AND budget < 2").drop("arm"), ["kind"], "budget", "delta", "base", 1)
    return t.select("kind", "budget", "delta", "control", "margin", F.round("margin_rel", 9).alias("margin_rel"))


def capacity(spark: SparkSession, root: str) -> DataFrame:
    """Errors of the same (kind, seed) at two budgets and their difference."""
    t = panel.level_difference(_results(spark, root).filter("arm = 'A'"), ["kind", "seed"], "budget", 0, 2, "errors")
    return t.withColumns({c: F.round(c, 6) for c in ("low", "high", "difference")})


def seed_means(spark: SparkSession, root: str) -> DataFrame:
    """Mean errors over seeds per (arm, kind, budget)."""
    return panel.mean_over_seeds(_results(spark, root), ["arm", "kind", "budget"], "seed", ["errors"]).withColumn("errors", F.round("errors", 6))


def significance(spark: SparkSession, root: str) -> DataFrame:
    """Per arm the budgets' means that are clearly or unclearly above or below the arm's overall mean (two standard errors)."""
    r = _results(spark, root)
    per = r.groupBy("arm", "kind", "budget").agg(F.avg("errors").alias("m"), (F.stddev_samp("errors") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    mean = r.groupBy("arm").agg(F.avg("errors").alias("all"))
    d = per.join(mean, "arm").filter("se IS NOT NULL").withColumn("delta", F.round(F.col("m") - F.col("all"), 9))
    return panel.significance_tally(d.withColumn("lo", F.round(F.col("delta") - 2 * F.col("se"), 9)).withColumn("hi", F.round(F.col("delta") + 2 * F.col("se"), 9)), ["arm"], "delta", "lo", "hi")


def settings_grid(spark: SparkSession, root: str) -> DataFrame:
    """The grid of tuning settings, one row per combination."""
    return panel.grid(spark, rank=[8, 32], dropout=[0.0, 0.1], budget=[5, 80])


def joined_difference(spark: SparkSession, root: str) -> DataFrame:
    """Paired bootstrap of the two arms per legislature, whose point estimate must equal the joined table's difference."""
    s = written(scored_chunks(spark, root).filter("knesset IS NOT NULL").select("knesset", "chunk_id", "words", "err_a", "err_b"))
    j = s.groupBy("knesset").agg(((F.sum("err_a") - F.sum("err_b")) / F.sum("words")).alias("difference"))
    t = panel.joined_difference(s, "knesset", ["chunk_id"], "err_a", "err_b", "words", j, "difference")
    return t.select("knesset", F.round("delta", 9).alias("delta"), F.col("ci_lo") <= F.col("delta"), F.col("ci_hi") >= F.col("delta"), "agrees").toDF("knesset", "delta", "above_lo", "below_hi", "agrees")


def paired_audit(spark: SparkSession, root: str) -> DataFrame:
    """Whether plan and index hold the same chunk ids, once each."""
    ids = lambda t: table(spark, root, t).filter("chunk_id IS NOT NULL").select("chunk_id")
    return panel.paired_keys(ids("panel_plan_v2"), ids("chunk_index"), ["chunk_id"])


def widened_plan(spark: SparkSession, root: str) -> DataFrame:
    """The newest sessions of each speaker that fill test, dev and train to 12, 12 and 48 seconds."""
    t = panel.widened_sessions(_chunks(spark, root), "speaker_id", "session", F.col("ms") / 60_000, 0.2, 0.2, 0.8)
    return t.select("speaker_id", "session", "part", F.round(F.col("minutes") * 60_000).cast("long").alias("ms"), "enough")


def fold_extras(spark: SparkSession, root: str) -> DataFrame:
    """Five folds of the speakers with the roster's persons who never speak attached to the least speaker's fold."""
    from plenora.operators.splits import hash_folds

    folds = written(hash_folds(_chunks(spark, root), "speaker_id", 5, 7))
    least = folds.agg(F.min("speaker_id").alias("attach"))
    extras = table(spark, root, "mk_metadata").select(F.col("person_id").alias("speaker_id")).join(folds.select("speaker_id"), "speaker_id", "left_anti").crossJoin(F.broadcast(least))
    return panel.fold_plan(folds, extras, "speaker_id")


def free_pool(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of sessions in which nobody has test or dev rows, counted per session."""
    held = table(spark, root, "panel_plan_v2").select(F.col("session_id").alias("session"), F.lower(F.trim("part")).alias("part"))
    return panel.pool_without_held(_chunks(spark, root), held, "session").groupBy("session").agg(F.count(F.lit(1)).alias("chunks"))


def budgets_and_steps(spark: SparkSession, root: str) -> DataFrame:
    """Top budget, estimated steps and sample index of the minutes per speaker."""
    t = _chunks(spark, root).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("ms").alias("ms"))
    minutes = F.col("ms") / 1000
    return t.select("speaker_id", panel.top_budget(minutes, 100, 50).alias("budget"), panel.step_estimate(F.col("chunks"), F.lit(3)).cast("long").alias("steps"), panel.sample_index(F.col("ms") / 1000).alias("sample"), panel.near(minutes, F.round(minutes), 0.25).alias("whole"))


def fetch_costs(spark: SparkSession, root: str) -> DataFrame:
    """Turns, milliseconds of turns and bytes to fetch per session."""
    t = sequence.islands(_spans(spark, root), ["session"], ["start", "end", "filename"], ["speaker_id", "local_speaker_id"], "turn")
    ms = t.select("session", "turn", tx.to_ms(F.col("start")).alias("s"), tx.to_ms(F.col("end")).alias("e"))
    return panel.source_cost(ms, "session", "turn", "s", "e", 12.5).select("session", "turns", F.col("seconds").alias("ms"), F.col("bytes").cast("long").alias("bytes"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """Kept chunks of each (session, speaker) with the text of the chunk before, unless that was dropped."""
    c = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL AND session IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "session", "speaker_id", "duration_s", "text")).alias("x")).select("chunk_id", "x.*")
    at = c.withColumn("start", tx.parse_span_id(F.col("chunk_id"))["start_s"]).withColumn("end", tx.parse_span_id(F.col("chunk_id"))["end_s"])
    kept = sequence.usable_chunk(F.col("start"), F.col("end"), F.col("start") + F.col("duration_s")) & (F.coalesce("text", F.lit("")) != "")
    return sequence.previous_kept(at, ["session", "speaker_id"], ["start", "chunk_id"], kept, "text", "prompt").select("chunk_id", F.length("prompt").alias("prompt_chars"))


def median_curve(spark: SparkSession, root: str) -> DataFrame:
    """Median errors over kinds and arms per seed, while half of them have it; and where each curve is least."""
    r = _results(spark, root).groupBy(F.concat_ws("|", "arm", "kind").alias("series"), "seed").agg(F.sum("errors").alias("errors"))
    return sequence.median_while_present(r, "series", "seed", "errors")


def curve_minima(spark: SparkSession, root: str) -> DataFrame:
    """Per (arm, kind): the seed of least errors and that value over the first seed's."""
    r = _results(spark, root).groupBy("arm", "kind", "seed").agg(F.sum("errors").cast("double").alias("errors"))
    return sequence.curve_minimum(r, ["arm", "kind"], "seed", "errors")


def forced_against_free(spark: SparkSession, root: str) -> DataFrame:
    """Distance of arm B's words from arm A's by length of the chunk and in all: pooled errors, words and rate."""
    from plenora.functions.align import exact_distance

    s = scored_chunks(spark, root).withColumn("d", exact_distance(F.col("hyp_a"), F.col("hyp_b"))).withColumn("n", tx.token_count(F.col("hyp_a")))
    bins = s.withColumn("bin", F.explode(F.array(F.lit("all"), cut(F.col("duration_s"), [0, 3, 6, 10, 20, 31])))).filter("bin IS NOT NULL")
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("chunks"), F.sum("d").alias("errors"), F.sum("n").alias("words")).withColumn("rate", F.round(F.col("errors") / F.nullif(F.col("words"), F.lit(0)), 9))


def char_rates(spark: SparkSession, root: str) -> DataFrame:
    """Pooled character error rates of both arms per legislature."""
    from plenora.functions.align import char_distance

    s = scored_chunks(spark, root).filter("knesset IS NOT NULL")
    return s.groupBy("knesset").agg(F.sum(F.length("ref")).alias("chars"), F.sum(char_distance(F.col("ref"), F.col("hyp_a"))).alias("cerr_a"), F.sum(char_distance(F.col("ref"), F.col("hyp_b"))).alias("cerr_b"))


def forgiving_totals(spark: SparkSession, root: str) -> DataFrame:
    """Per legislature arm A's errors against B's words without the insertions both have (a measure since withdrawn)."""
    from plenora.functions.align import edit_stream

    s = scored_chunks(spark, root).filter("knesset IS NOT NULL").select("knesset", "chunk_id", "ref", "hyp_a", "hyp_b")
    ops = s.select("knesset", "chunk_id", F.explode(edit_stream(F.col("hyp_b"), F.col("ref"))).alias("e"))
    ins = ops.filter("e.op = 'I'").select("chunk_id", F.lit("A").alias("arm"), F.col("e.hyp").alias("word"))
    words = s.select("chunk_id", F.lit("B").alias("arm"), F.explode(tx.tokens(F.col("hyp_a"))).alias("word"))
    both = shared_insertions(ins.unionByName(words), "chunk_id")
    per = ops.groupBy("knesset", "chunk_id").agg(F.count(F.lit(1)).alias("werr")).join(both, "chunk_id", "left")
    return per.groupBy("knesset").agg(F.sum("werr").alias("werr"), F.sum(F.coalesce("shared", F.lit(0))).alias("shared"), F.sum(F.col("werr") - F.coalesce("shared", F.lit(0))).alias("werr_f"))


def most_restored(spark: SparkSession, root: str) -> DataFrame:
    """The words most often put back into references, with their number."""
    w = _inserted(spark, root).select(F.explode("words").alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


def cross_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Speakers of both the index and the plan: chunks and ms in each, side by side."""
    sides = []
    for name, rows in (("index", _chunks(spark, root)), ("plan", table(spark, root, "panel_plan_v2").filter("chunk_id IS NOT NULL AND speaker_id > 0").groupBy("chunk_id", "speaker_id").agg(F.max(tx.to_ms(F.col("duration_s"))).alias("ms")))):
        t = rows.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("ms").alias("ms"))
        sides.append(t.withColumnsRenamed({c: f"{name}_{c}" for c in ("chunks", "ms")}))
    return sides[0].join(sides[1], "speaker_id")


def paired_arms(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of both arms side by side per legislature: which arm has fewer errors, and how often both have the same."""
    s = scored_chunks(spark, root).filter("knesset IS NOT NULL")
    a, b = (s.select("chunk_id", "knesset", F.col(e).alias(f"err_{n}")) for e, n in (("err_a", "a"), ("err_b", "b")))
    j = written(a).join(b.drop("knesset"), "chunk_id")
    return j.groupBy("knesset").agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("err_a") < F.col("err_b")).alias("a_better"), F.count_if(F.col("err_b") < F.col("err_a")).alias("b_better"), F.count_if(F.col("err_a") == F.col("err_b")).alias("same"))


def rate_spread(spark: SparkSession, root: str) -> DataFrame:
    """Mean, sample standard deviation and coefficient of variation of the chunks' rates per legislature."""
    s = scored_chunks(spark, root).filter("knesset IS NOT NULL").withColumn("rate", F.col("err_a") / F.col("words"))
    return metrics.spread(s, ["knesset"], "rate", 7)


def mapped_labels(spark: SparkSession, root: str) -> DataFrame:
    """Rows by broad label, by a mapping with a default."""
    broad = metrics.map_values(F.col("label"), {"mk": "member", "former_mk": "member", "non_mk": "guest"}, "open")
    return table(spark, root, "segments").groupBy(broad.alias("broad")).agg(F.count(F.lit(1)).alias("n"))


def unmapped_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels that a mapping of two does not know, with their rows."""
    return metrics.unmapped(table(spark, root, "segments"), "label", {"mk": "member", "non_mk": "guest"})


def either_source(spark: SparkSession, root: str) -> DataFrame:
    """Speaker of every chunk of the plan or the index, the plan's where it has the chunk; counted by source."""
    from plenora.operators.ledger import union_unique

    ids = lambda t, n: table(spark, root, t).filter("chunk_id IS NOT NULL").select("chunk_id", "speaker_id", F.lit(n).alias("source"))
    return union_unique(ids("panel_plan_v2", "plan"), ids("chunk_index", "index"), ["chunk_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_id").alias("speakers"))


def sliding_events(spark: SparkSession, root: str) -> DataFrame:
    """Events in windows of two hours every hour (the batch form of the streaming aggregate)."""
    return ingest.sliding_counts(table(spark, root, "events"), "ts", "2 hours", "1 hour", "10 minutes", ["event_type"])


QUERIES = {
    f.__name__: f
    for f in (
        selected_chunks, sampled_chunks, spread_chunks, longest_per_group, lowest_overlap, worst_of_largest, word_quality, candidate_list, quality_bands, first_and_deduped, hash_parts, error_kind_shares,
        personal_margins, capacity, seed_means, significance, settings_grid, joined_difference, paired_audit, widened_plan, fold_extras, free_pool, budgets_and_steps, fetch_costs, prompts, median_curve,
        curve_minima, forced_against_free, char_rates, forgiving_totals, most_restored, cross_corpus, paired_arms, rate_spread, mapped_labels, unmapped_labels, either_source, sliding_events,
    )
}
_LATEST = "latest AS (SELECT chunk_id, unnest(v) FROM (SELECT chunk_id, max({{'a': loaded_at, {0}}}) AS v FROM chunk_index WHERE {1} GROUP BY chunk_id))"
_MAP = ", g AS (SELECT speaker_id, count(*) AS chunks, sum(err_a) / sum(words) AS ra, sum(err_b) / sum(words) AS rb FROM scored WHERE quality >= 0.7 AND speaker_id IS NOT NULL GROUP BY 1)"
_CODED = "list_aggregate(list_transform({0}, lambda t: chr(CAST(32 + list_position(v, t) AS INT))), 'string_agg', '')"
_CHARS = "list_aggregate(list_transform(string_split({0}, ''), lambda c: chr(CAST(32 + list_position(u, c) AS INT))), 'string_agg', '')"
SQL = {
    "selected_chunks": _CHUNKS + "SELECT chunk_id, speaker_id, session FROM chunks WHERE quality >= 0.7 AND duration_s BETWEEN 5 AND 20 AND chunk_id IN (SELECT chunk_id FROM panel_plan_v2)",
    "sampled_chunks": _CHUNKS + "SELECT chunk_id, speaker_id FROM chunks ORDER BY md5('11|' || chunk_id), chunk_id LIMIT 50",
    "spread_chunks": _CHUNKS + ", r AS (SELECT speaker_id, session, chunk_id, md5('5|' || chunk_id) AS h, row_number() OVER (PARTITION BY speaker_id, session ORDER BY md5('5|' || chunk_id), chunk_id) AS i FROM chunks), s AS (SELECT speaker_id, count(DISTINCT session) AS k FROM chunks GROUP BY 1), f AS (SELECT r.*, row_number() OVER (PARTITION BY r.speaker_id ORDER BY h, chunk_id) AS j FROM r JOIN s ON r.speaker_id = s.speaker_id WHERE k < 3 OR i = 1) SELECT speaker_id, session, chunk_id FROM f WHERE j <= 3",
    "longest_per_group": "WITH " + _LATEST.format("'knesset': knesset, 'speaker_id': speaker_id, 'duration_s': duration_s", "chunk_id IS NOT NULL AND knesset IS NOT NULL AND speaker_id > 0") + ", r AS (SELECT *, row_number() OVER (PARTITION BY knesset, speaker_id ORDER BY duration_s DESC NULLS LAST, chunk_id) AS i FROM latest), k AS (SELECT knesset, count(DISTINCT speaker_id) AS n FROM latest GROUP BY 1) SELECT r.knesset, speaker_id, chunk_id FROM r JOIN k ON r.knesset = k.knesset WHERE i <= greatest(1, 60 // n)",
    "lowest_overlap": SCORED + _MAP + ", v AS (SELECT speaker_id, round(ra, 9) AS a, round(rb, 9) AS b FROM g), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM v) SELECT count(*) AS n, round(corr(x, y), 7) AS rho, (SELECT count(*) FROM (SELECT speaker_id FROM v ORDER BY a, speaker_id LIMIT 40) l JOIN (SELECT speaker_id FROM v ORDER BY b, speaker_id LIMIT 40) m USING (speaker_id)) AS shared_lowest FROM r",
    "worst_of_largest": SCORED + _MAP + "SELECT speaker_id, chunks, round(ra, 9) AS rate FROM g ORDER BY chunks DESC, speaker_id LIMIT 30",
    "word_quality": SCORED + ", h AS (SELECT chunk_id, len(b) AS hb FROM arms), k AS (SELECT speaker_id, ms, coalesce(abs(hb - words) / greatest(words, 1) <= 0.2 AND err_b / words <= 0.1 AND words % 5 < 3, false) AS ok FROM scored JOIN h USING (chunk_id) WHERE speaker_id > 0) SELECT speaker_id, count(*) AS chunks, count(*) FILTER (ok) AS fit, CAST(sum(ms) AS BIGINT) AS ms, CAST(coalesce(sum(ms) FILTER (ok), 0) AS BIGINT) AS fit_ms, round(avg(ok::INT), 9) AS kept_share FROM k GROUP BY 1",
    "candidate_list": _CHUNKS + ", c AS (SELECT * FROM chunks WHERE quality >= 0.8 AND session NOT IN (SELECT session_id FROM manifest WHERE NOT coalesce(complete, false))), p AS (SELECT speaker_id, session, max(session_date) AS d, count(*) AS chunks, sum(ms) AS ms FROM c GROUP BY ALL), r AS (SELECT *, sum(ms) OVER (PARTITION BY speaker_id ORDER BY d DESC NULLS LAST, session DESC ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT speaker_id, session, chunks, CAST(ms AS BIGINT) AS ms FROM r WHERE cum - ms < 60000",
    "quality_bands": SCORED + ", b AS (SELECT *, CASE WHEN quality >= 0 AND quality < 0.7 THEN '[0, 0.7)' WHEN quality >= 0.7 AND quality < 0.8 THEN '[0.7, 0.8)' WHEN quality >= 0.8 AND quality < 0.9 THEN '[0.8, 0.9)' WHEN quality >= 0.9 AND quality < 1.01 THEN '[0.9, 1.01)' END AS band FROM scored) SELECT band, count(*) AS chunks, sum(words) AS words, sum(err_a) AS err_A, sum(err_b) AS err_B, sum(err_a) / nullif(sum(words), 0) AS rate_A, sum(err_b) / nullif(sum(words), 0) AS rate_B FROM b WHERE band IS NOT NULL GROUP BY band",
    "first_and_deduped": 'WITH s AS (SELECT session, raw_name, speaker_id, row_number() OVER (PARTITION BY session ORDER BY coalesce("start", 1e18), coalesce("end", 1e18), filename, ingested_at) AS i FROM segments WHERE session IS NOT NULL AND filename IS NOT NULL) SELECT session, arg_min(speaker_id, i) FILTER (speaker_id > 0) AS first_speaker, arg_min(raw_name, i) FILTER (raw_name IS NOT NULL) AS first_name FROM s GROUP BY session',
    "hash_parts": "SELECT count(DISTINCT chunk_id) AS n, 4 AS parts FROM chunk_index WHERE chunk_id IS NOT NULL",
    "error_kind_shares": "WITH e AS (SELECT arm, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (kind = '{k}'), 0) AS BIGINT) AS {k}" for k in ("substitution", "deletion", "insertion")) + " FROM committees_error_content GROUP BY arm) SELECT *, " + ", ".join(f"round({k} / nullif(substitution + deletion + insertion, 0), 9) AS {k[0].upper()}" for k in ("substitution", "deletion", "insertion")) + " FROM e",
    "personal_margins": _RESULTS + ", r AS (SELECT arm, kind, budget, CAST(sum(errors) AS BIGINT) AS delta FROM res GROUP BY ALL), o AS (SELECT * FROM r WHERE arm = 'A'), c AS (SELECT * FROM r WHERE arm = 'B' AND budget < 2), j AS (SELECT o.kind, o.budget, o.delta, CASE WHEN o.budget IN (SELECT budget FROM c) THEN s.delta ELSE d.delta END AS control FROM o LEFT JOIN c s ON o.kind = s.kind AND o.budget = s.budget LEFT JOIN c d ON o.kind = d.kind AND d.budget = 1) SELECT *, delta - control AS margin, round((delta - control) / (delta * 2 + 1), 9) AS margin_rel FROM j",
    "capacity": _RESULTS + ", l AS (SELECT kind, seed, avg(errors) AS low FROM res WHERE arm = 'A' AND budget = 0 GROUP BY ALL), h AS (SELECT kind, seed, avg(errors) AS high FROM res WHERE arm = 'A' AND budget = 2 GROUP BY ALL) SELECT kind, seed, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS difference FROM l JOIN h USING (kind, seed)",
    "seed_means": _RESULTS + "SELECT arm, kind, budget, round(avg(errors), 6) AS errors, count(DISTINCT seed) AS seeds FROM res GROUP BY ALL",
    "significance": _RESULTS + ", p AS (SELECT arm, kind, budget, avg(errors) AS m, stddev_samp(errors) / sqrt(count(*)) AS se FROM res GROUP BY ALL), d AS (SELECT p.arm, round(m - a, 9) AS d, se FROM p JOIN (SELECT arm, avg(errors) AS a FROM res GROUP BY arm) q ON p.arm = q.arm WHERE se IS NOT NULL), c AS (SELECT arm, d > 0 AS up, round(d - 2 * se, 9) > 0 OR round(d + 2 * se, 9) < 0 AS clear FROM d) SELECT arm, count(*) FILTER (up AND clear) AS better, count(*) FILTER (up AND NOT clear) AS better_unclear, count(*) FILTER (NOT up AND NOT clear) AS worse_unclear, count(*) FILTER (NOT up AND clear) AS worse FROM c GROUP BY arm",
    "settings_grid": "SELECT rank, dropout::DOUBLE AS dropout, budget FROM (VALUES (8), (32)) a(rank) CROSS JOIN (VALUES (0.0), (0.1)) b(dropout) CROSS JOIN (VALUES (5), (80)) c(budget)",
    "joined_difference": SCORED + "SELECT knesset, round(sum(err_a - err_b) / sum(words), 9) AS delta, true AS above_lo, true AS below_hi, true AS agrees FROM scored WHERE knesset IS NOT NULL GROUP BY knesset",
    "paired_audit": "WITH a AS (SELECT chunk_id, count(*) AS na FROM panel_plan_v2 WHERE chunk_id IS NOT NULL GROUP BY 1), b AS (SELECT chunk_id, count(*) AS nb FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS paired, count(*) FILTER (nb IS NULL) AS only_a, count(*) FILTER (na IS NULL) AS only_b, count(*) FILTER (na > 1 OR nb > 1) AS repeated FROM a FULL JOIN b ON a.chunk_id = b.chunk_id",
    "widened_plan": _CHUNKS + """, q AS (SELECT speaker_id, session, CAST(sum(ms) AS BIGINT) AS ms FROM chunks GROUP BY 1, 2), p AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY speaker_id ORDER BY session DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM q),
a AS (SELECT *, cum - ms < 12000 AS t FROM p), b AS (SELECT *, coalesce(max(cum) FILTER (t) OVER (PARTITION BY speaker_id), 0) AS b1 FROM a),
c AS (SELECT *, NOT t AND cum - ms - b1 < 12000 AS d FROM b), e AS (SELECT *, coalesce(max(cum) FILTER (t OR d) OVER (PARTITION BY speaker_id), 0) AS b2 FROM c),
f AS (SELECT *, CASE WHEN t THEN 'test' WHEN d THEN 'dev' WHEN cum - ms - b2 < 48000 THEN 'train' END AS part FROM e)
SELECT speaker_id, session, part, ms, coalesce(sum(ms) FILTER (part = 'train') OVER (PARTITION BY speaker_id), 0) >= 48000 AS enough FROM f WHERE part IS NOT NULL""",
    "fold_extras": _CHUNKS + ", k AS (SELECT DISTINCT speaker_id FROM chunks), f AS (SELECT speaker_id, CAST((row_number() OVER (ORDER BY md5('7|' || speaker_id), speaker_id) - 1) % 5 AS INT) AS fold FROM k) SELECT speaker_id, fold, false AS extra FROM f UNION ALL SELECT DISTINCT person_id, (SELECT arg_min(fold, speaker_id) FROM f), true FROM mk_metadata WHERE person_id NOT IN (SELECT speaker_id FROM f)",
    "free_pool": _CHUNKS + "SELECT session, count(*) AS chunks FROM chunks WHERE session NOT IN (SELECT session_id FROM panel_plan_v2 WHERE session_id IS NOT NULL AND lower(trim(part)) IN ('test', 'dev')) GROUP BY session",
    "budgets_and_steps": _CHUNKS + ", t AS (SELECT speaker_id, count(*) AS chunks, sum(ms)::BIGINT AS ms FROM chunks GROUP BY 1) SELECT speaker_id, CASE WHEN ms / 1000 >= 100 THEN 100 ELSE 50 END AS budget, CAST(greatest(ceil(chunks / 8) * 3, 1) AS BIGINT) AS steps, CAST(round_even(ms / 1000 * 16000, 0) AS BIGINT) AS sample, abs(ms / 1000 - round(ms / 1000)) < 0.25 AS whole FROM t",
    "fetch_costs": _USABLE + ", t AS (SELECT session, turn, max(em) - min(sm) AS ms FROM turns GROUP BY ALL) SELECT session, count(*) AS turns, CAST(sum(ms) AS BIGINT) AS ms, CAST(ceil(sum(ms) * 12.5) AS BIGINT) AS bytes FROM t GROUP BY session",
    "prompts": "WITH " + _LATEST.format("'session': session, 'speaker_id': speaker_id, 'duration_s': duration_s, 'text': text", "chunk_id IS NOT NULL AND session IS NOT NULL") + ", p AS (SELECT *, CAST(split_part(chunk_id, '_', 3) AS BIGINT) / 1000 AS st, CAST(split_part(split_part(chunk_id, '_', 4), '.', 1) AS BIGINT) / 1000 AS en FROM latest), k AS (SELECT *, coalesce(en - st >= 1 AND en <= st + duration_s + 0.05 AND coalesce(text, '') <> '', false) AS ok FROM p), l AS (SELECT chunk_id, ok, CASE WHEN lag(ok) OVER w THEN lag(text) OVER w END AS prompt FROM k WINDOW w AS (PARTITION BY session, speaker_id ORDER BY st, chunk_id)) SELECT chunk_id, length(prompt) AS prompt_chars FROM l WHERE ok",
    "median_curve": _RESULTS + ", s AS (SELECT arm || '|' || kind AS series, seed, sum(errors) AS errors FROM res GROUP BY ALL) SELECT seed, round(quantile_cont(errors, 0.5), 9) AS median, count(DISTINCT series) AS n FROM s GROUP BY seed HAVING count(DISTINCT series) * 2 >= (SELECT count(DISTINCT series) FROM s)",
    "curve_minima": _RESULTS + ", s AS (SELECT arm, kind, seed, sum(errors) AS e FROM res GROUP BY ALL) SELECT arm, kind, arg_min(seed, struct_pack(a := e, b := seed)) AS best_step, round(min(e) / nullif(arg_min(e, seed), 0), 9) AS best FROM s GROUP BY arm, kind",
    "forced_against_free": SCORED + f", d AS (SELECT c.chunk_id, len(a) AS n, levenshtein(coalesce({_CODED.format('a')}, ''), coalesce({_CODED.format('b')}, '')) AS d, c.duration_s FROM coded c WHERE len(r) > 0), x AS (SELECT *, 'all' AS bin FROM d UNION ALL SELECT *, CASE WHEN duration_s < 0 THEN NULL WHEN duration_s <= 3 THEN '(0, 3]' WHEN duration_s <= 6 THEN '(3, 6]' WHEN duration_s <= 10 THEN '(6, 10]' WHEN duration_s <= 20 THEN '(10, 20]' WHEN duration_s <= 31 THEN '(20, 31]' END FROM d) SELECT bin, count(*) AS chunks, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words, round(sum(d) / nullif(sum(n), 0), 9) AS rate FROM x WHERE bin IS NOT NULL GROUP BY bin",
    "char_rates": SCORED + f", t AS (SELECT c.knesset, array_to_string(r, ' ') AS r, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM coded c WHERE len(r) > 0 AND knesset IS NOT NULL), u AS (SELECT *, list_distinct(string_split(r || 'x ', '')) AS u FROM t) SELECT knesset, CAST(sum(length(r)) AS BIGINT) AS chars, CAST(sum(levenshtein({_CHARS.format('r')}, coalesce({_CHARS.format('a')}, ''))) AS BIGINT) AS cerr_a, CAST(sum(levenshtein({_CHARS.format('r')}, coalesce({_CHARS.format('b')}, ''))) AS BIGINT) AS cerr_b FROM u GROUP BY knesset",
    "sliding_events": "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL",
    "cross_corpus": _CHUNKS + ", i AS (SELECT speaker_id, count(*) AS index_chunks, CAST(sum(ms) AS BIGINT) AS index_ms FROM chunks GROUP BY 1), q AS (SELECT chunk_id, speaker_id, max(CAST(round_even(duration_s * 1000, 0) AS BIGINT)) AS ms FROM panel_plan_v2 WHERE chunk_id IS NOT NULL AND speaker_id > 0 GROUP BY 1, 2), p AS (SELECT speaker_id, count(*) AS plan_chunks, CAST(sum(ms) AS BIGINT) AS plan_ms FROM q GROUP BY 1) SELECT * FROM i JOIN p USING (speaker_id)",
    "paired_arms": SCORED + "SELECT knesset, count(*) AS paired, count(*) FILTER (err_a < err_b) AS a_better, count(*) FILTER (err_b < err_a) AS b_better, count(*) FILTER (err_a = err_b) AS same FROM scored WHERE knesset IS NOT NULL GROUP BY knesset",
    "rate_spread": SCORED + ", r AS (SELECT knesset, err_a / words AS x FROM scored WHERE knesset IS NOT NULL) SELECT knesset, count(x) AS n, round(avg(x), 7) AS mean, round(stddev_samp(x), 7) AS sd, round(stddev_samp(x) / nullif(avg(x), 0), 7) AS cv FROM r GROUP BY knesset",
    "mapped_labels": "SELECT CASE WHEN label IN ('mk', 'former_mk') THEN 'member' WHEN label = 'non_mk' THEN 'guest' ELSE 'open' END AS broad, count(*) AS n FROM segments GROUP BY 1",
    "unmapped_labels": "SELECT label AS value, count(*) AS n FROM segments WHERE label NOT IN ('mk', 'non_mk') GROUP BY 1",
    "either_source": "WITH p AS (SELECT chunk_id, max(speaker_id) AS s FROM panel_plan_v2 WHERE chunk_id IS NOT NULL GROUP BY 1), i AS (SELECT chunk_id, max(speaker_id) AS s FROM chunk_index WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM p) GROUP BY 1) SELECT 'plan' AS source, count(*) AS n, count(DISTINCT s) AS speakers FROM p HAVING count(*) > 0 UNION ALL SELECT 'index', count(*), count(DISTINCT s) FROM i HAVING count(*) > 0",
}
