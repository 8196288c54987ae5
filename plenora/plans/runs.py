"""Queries on run logs, curves and second test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.functions.align import multiset_rest, restore_shared, shared_insertions
from plenora.functions.text import tokens
from plenora.operators import ledger, sequence, splits
from plenora.plans.scoring import SCORED, scored_chunks
from plenora.sources.tables import table


def daily_trend(spark: SparkSession, root: str) -> DataFrame:
    """Events per day and type with the mean of the last four days."""
    d = table(spark, root, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequence.trailing_mean(d, ["event_type"], ["day"], "n", 4, "mean4").withColumns({"mean4": F.round("mean4", 6), "day": F.col("day").cast("string")})


def hardest_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Meetings by rate, with the share of all errors that they and all harder ones hold."""
    s = scored_chunks(spark, root).filter("session IS NOT NULL").groupBy("knesset", "session").agg(F.sum("words").alias("words"), F.sum("err_a").alias("errors"))
    r = s.withColumn("rate", F.round(F.col("errors") / F.col("words"), 9))
    return sequence.suffix_share(r, ["knesset"], ["rate", "session"], "errors", "share").withColumn("share", F.round("share", 9))


def lower_bound_test(spark: SparkSession, root: str) -> DataFrame:
    """The plan's test meetings at a lower quality bound, counted per speaker with the share from the plan's own test."""
    plan = table(spark, root, "panel_plan_v2").filter("session_id IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "speaker_id", F.col("session_id").alias("session"), F.lower(F.trim("part")).alias("part"))
    corpus = ledger.latest_success(table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL"), ["chunk_id"], F.lit(True), "loaded_at", ["speaker_id", "session", "quality"])
    t = splits.second_test_set(plan, corpus, "speaker_id", "session", "chunk_id", "quality", 0.6)
    return t.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("hq").alias("hq"))


def chair_companions(spark: SparkSession, root: str) -> DataFrame:
    """The ten persons who share most meetings with the person who chairs most rows."""
    seg = table(spark, root, "segments")
    top = seg.filter("is_chairman AND speaker_id > 0").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "speaker_id").first()
    return splits.companions(seg, "speaker_id", "session", top[0] if top else -1, 10)


def event_latency(spark: SparkSession, root: str) -> DataFrame:
    """Median, 95 % point and maximum of the values by event type."""
    t = ledger.latency_summary(table(spark, root, "events"), ["event_type"], "value")
    return t.withColumns({c: F.round(c, 6) for c in ("median_s", "p95_s", "max_s")})


def log_progress(spark: SparkSession, root: str) -> DataFrame:
    """Events read as a run log: done, failed, spend, rate and time left."""
    e = table(spark, root, "events").withColumn("one", F.lit(1.0))
    p = ledger.progress(e, F.col("event_type") != "error", "one", "ts", 100_000, 0.01)
    return p.select("done", "failed", *[F.round(c, 3).alias(c) for c in ("amount", "spend", "projected")], F.round("rate", 9).alias("rate"), F.round("seconds_left", 1).alias("seconds_left"))


def _inserted(spark: SparkSession, root: str) -> DataFrame:
    """Arm A's words against the reference heard by B: the restored text and the words put back, in order."""
    s = scored_chunks(spark, root).filter("speaker_id > 0").withColumn("r", restore_shared(F.col("hyp_a"), F.col("ref"), F.col("hyp_b")))
    # Words put back are those that the restored text has more of than the hypothesis it began with.
    back, own = tokens(F.col("r.text")), tokens(F.col("hyp_a"))
    return s.select("speaker_id", "chunk_id", "words", F.col("r.n_inserted").alias("n_inserted"), back.alias("new"), own.alias("old")).withColumn("words_back", multiset_rest(F.col("new"), F.col("old"))).withColumnRenamed("words", "n_words").withColumnRenamed("words_back", "words")


def restored_references(spark: SparkSession, root: str) -> DataFrame:
    """Per speaker: chunks, share of them whose reference changes, words put back and per hundred of the reference's."""
    s = _inserted(spark, root)
    t = s.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n_inserted") > 0).alias("changed"), F.sum("n_inserted").cast("long").alias("n_inserted"), F.sum("n_words").alias("words"))
    return t.withColumn("share", F.round(F.col("changed") / F.col("chunks"), 9)).withColumn("per_hundred", F.round(100 * F.col("n_inserted") / F.col("words"), 9))


def shared_words(spark: SparkSession, root: str) -> DataFrame:
    """Per chunk the number of words that both hypotheses hold, as multisets."""
    s = scored_chunks(spark, root)
    each = s.select("chunk_id", F.explode(F.array(F.struct(F.lit("A").alias("arm"), F.split("hyp_a", " ").alias("w")), F.struct(F.lit("B").alias("arm"), F.split("hyp_b", " ").alias("w")))).alias("x"))
    return shared_insertions(each.select("chunk_id", "x.arm", F.explode("x.w").alias("word")), "chunk_id")


QUERIES = {f.__name__: f for f in (daily_trend, hardest_sessions, lower_bound_test, chair_companions, event_latency, log_progress, restored_references, shared_words)}
SQL = {
    "daily_trend": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS 3 PRECEDING), 6) AS mean4 FROM d",
    "hardest_sessions": SCORED + ", s AS (SELECT knesset, session, sum(words) AS words, sum(err_a) AS errors FROM scored WHERE session IS NOT NULL GROUP BY ALL), r AS (SELECT *, round(errors / words, 9) AS rate FROM s) SELECT *, round(sum(errors) OVER (PARTITION BY knesset ORDER BY rate, session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(errors) OVER (PARTITION BY knesset), 0), 9) AS share FROM r",
    "lower_bound_test": "WITH p AS (SELECT chunk_id, speaker_id, session_id AS session FROM panel_plan_v2 WHERE session_id IS NOT NULL AND chunk_id IS NOT NULL AND lower(trim(part)) = 'test'), c AS (SELECT chunk_id, unnest(v) FROM (SELECT chunk_id, arg_max(struct_pack(speaker_id, session, quality), loaded_at) AS v FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY 1)) SELECT speaker_id, count(*) AS chunks, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM p)) AS hq FROM c WHERE quality >= 0.6 AND EXISTS (SELECT 1 FROM p WHERE p.speaker_id = c.speaker_id AND p.session = c.session) GROUP BY speaker_id",
    "chair_companions": "WITH c AS (SELECT speaker_id AS c FROM segments WHERE is_chairman AND speaker_id > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT speaker_id, count(DISTINCT session) AS shared FROM segments WHERE speaker_id > 0 AND speaker_id NOT IN (SELECT c FROM c) AND session IN (SELECT session FROM segments WHERE speaker_id IN (SELECT c FROM c)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "event_latency": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median_s, round(quantile_cont(value, 0.95), 6) AS p95_s, round(max(value), 6) AS max_s FROM events GROUP BY 1",
    "log_progress": "WITH a AS (SELECT count(*) FILTER (event_type <> 'error')::DOUBLE AS ok, count(*) FILTER (event_type = 'error') AS bad, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events) SELECT CAST(ok AS BIGINT) AS done, bad AS failed, round(ok, 3) AS amount, round(ok * 0.01::DOUBLE, 3) AS spend, 1000.0::DOUBLE AS projected, round(ok / nullif(s, 0), 9) AS rate, round((100000 - ok) / nullif(ok / nullif(s, 0), 0), 1) AS seconds_left FROM a",
    "shared_words": SCORED + ", w AS (SELECT chunk_id, w, sum(x) AS na, sum(y) AS nb FROM (SELECT chunk_id, unnest(a) AS w, 1 AS x, 0 AS y FROM arms WHERE len(r) > 0 UNION ALL SELECT chunk_id, unnest(b), 0, 1 FROM arms WHERE len(r) > 0) GROUP BY ALL) SELECT chunk_id, CAST(sum(least(na, nb)) AS BIGINT) AS shared FROM w GROUP BY chunk_id",
}
