"""Queries on segments, plans, names, sessions and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.functions import text as tx
from plenora.functions.binning import weighted_median
from plenora.operators import checks, ledger, metrics, resolve, sequence, splits
from plenora.operators.intervals import merge_close, point_in_span
from plenora.operators.segments import usable_spans
from plenora.sources.tables import table
from plenora.streaming import ingest

# ---- segments ---------------------------------------------------------------

_EXTRA = ["speaker_id", "local_speaker_id"]


def _spans(spark: SparkSession, root: str) -> DataFrame:
    return usable_spans(table(spark, root, "segments"), _EXTRA)


def speaker_turns(spark: SparkSession, root: str) -> DataFrame:
    """Runs of equal (speaker, local speaker) over all usable rows of a session, resolved or not; then the assigned ones."""
    t = sequence.islands(_spans(spark, root), ["session"], ["start", "end", "filename"], _EXTRA, "turn")
    runs = t.groupBy("session", "turn", "speaker_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(tx.to_ms(F.col("start"))).alias("start_ms"), F.max(tx.to_ms(F.col("end"))).alias("end_ms"))
    return runs.filter("speaker_id > 0")


_USABLE = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC NULLS LAST, session DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST, speaker_id DESC NULLS LAST, local_speaker_id DESC NULLS LAST) AS rn
  FROM segments WHERE filename IS NOT NULL),
spans AS (
  SELECT filename, session, "start" AS s, "end" AS e, speaker_id, local_speaker_id, CAST(round_even("start" * 1000, 0) AS BIGINT) AS sm, CAST(round_even("end" * 1000, 0) AS BIGINT) AS em
  FROM latest WHERE rn = 1 AND session IS NOT NULL AND "end" > "start" AND NOT isnan("start") AND NOT isnan("end")),
marked AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER w OR local_speaker_id IS DISTINCT FROM lag(local_speaker_id) OVER w THEN 1 ELSE 0 END AS b
  FROM spans WINDOW w AS (PARTITION BY session ORDER BY s, e, filename)),
turns AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY s, e, filename ROWS UNBOUNDED PRECEDING) AS turn FROM marked)
"""


def merged_speech(spark: SparkSession, root: str) -> DataFrame:
    """Spans of a turn merged where the gap is under 0.3 s."""
    t = sequence.islands(_spans(spark, root), ["session"], ["start", "end", "filename"], _EXTRA, "turn")
    ms = t.select("session", "turn", "filename", tx.to_ms(F.col("start")).alias("start"), tx.to_ms(F.col("end")).alias("end"))
    return merge_close(ms, ["session", "turn"], "start", "end", 300, ["filename"]).select("session", "turn", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n_spans")


def turn_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows of at most 30 s packed greedily from the spans of every assigned turn."""
    t = sequence.islands(_spans(spark, root), ["session"], ["start", "end", "filename"], _EXTRA, "turn").filter("speaker_id > 0")
    p = sequence.greedy_windows(t, ["session", "turn"], "start", "end")
    return p.select("session", "turn", "window", tx.to_ms(F.col("seek")).alias("seek_ms"), tx.to_ms(F.col("end")).alias("end_ms"), "n_spans")


def session_quality(spark: SparkSession, root: str) -> DataFrame:
    """Duration-weighted median quality per session."""
    rows = usable_spans(table(spark, root, "segments"), ["quality"]).withColumn("w", tx.to_ms(F.col("end")) - tx.to_ms(F.col("start")))
    m = weighted_median(rows, ["session"], "quality", "w", "q")
    return m.select("session", F.round("q", 7).alias("quality"))


def longest_good_run(spark: SparkSession, root: str) -> DataFrame:
    """Per session the longest run of rows of quality 0.7 or more."""
    rows = usable_spans(table(spark, root, "segments"), ["quality"]).withColumn("good", F.col("quality") >= 0.7)
    return sequence.longest_run(rows, ["session"], ["start", "end", "filename"], "good", "longest")


def midpoints_in_spans(spark: SparkSession, root: str) -> DataFrame:
    """Per planned chunk the number of speech spans that hold its midpoint, with 0.05 s of slack."""
    plan = table(spark, root, "panel_plan_v2").filter("session_id IS NOT NULL").select("chunk_id", F.col("session_id").alias("session"), (F.col("session_offset_s") + F.col("duration_s") / 2).alias("mid")).distinct()
    hits = point_in_span(plan, _spans(spark, root).select("session", F.col("start").alias("s"), F.col("end").alias("e")), ["session"], "mid", "s", "e", 30.0, 0.05)
    return hits.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_spans"))


def label_ladder(spark: SparkSession, root: str) -> DataFrame:
    """Label and reason of every segment row by the gold ladder, counted by path and given label."""
    s = table(spark, root, "segments")
    born, on = F.col("date_of_birth").try_cast("date"), F.col("session_date").try_cast("date")
    known = table(spark, root, "mk_metadata").select(F.col("person_id").cast("string").alias("gold_speaker_id"), F.lit(True).alias("known"), F.col("full_name"), "is_current", "date_of_death")
    j = s.join(known, "gold_speaker_id", "left")
    x = resolve.label_with_gold(
        F.coalesce(F.col("reason"), F.lit("")) != "bad_offset", F.col("gold_speaker_id"), F.lit(True), tx.is_garbage_name(F.col("raw_name")), F.col("known"), resolve.tokens_agree(tx.clean_name(F.col("raw_name")), tx.normalize_text(F.col("full_name"))),
        F.col("is_current"), resolve.implausible(on, born, F.col("date_of_death")),
    )
    return j.withColumn("x", x).groupBy("label_path", F.col("label").alias("given"), F.col("x.label").alias("label"), F.col("x.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_GARBAGE = "(raw_name IS NULL OR trim(raw_name) = '' OR contains(raw_name, ':') OR regexp_matches(raw_name, '\\d') OR trim(regexp_replace(raw_name, '\\s*\\([^)]*\\)', '', 'g')) = '' OR length(trim(regexp_replace(raw_name, '\\s*\\([^)]*\\)', '', 'g'))) > 60 OR len(string_split_regex(trim(regexp_replace(raw_name, '\\s*\\([^)]*\\)', '', 'g')), '\\s+')) > 8)"
_NORM = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+|_+', ' ', 'g'))"
_CLEAN = "CASE WHEN NOT " + _GARBAGE + " THEN nullif(" + _NORM.format("regexp_replace(trim(regexp_replace(raw_name, '\\s*\\([^)]*\\)', ' ', 'g')), '" + tx.TITLE.replace("'", "''") + "', '')") + ", '') END"
_AGREE = "(len({a}) > 0 AND len({b}) > 0 AND ((len(list_filter({a}, lambda t: NOT list_contains({b}, t))) = 0 AND len(list_filter({b}, lambda t: NOT list_contains({a}, t))) = 0) OR (len({a}) >= 2 AND len(list_filter({a}, lambda t: NOT list_contains({b}, t))) = 0) OR (len({b}) >= 2 AND len(list_filter({b}, lambda t: NOT list_contains({a}, t))) = 0)))"


def clean_names(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct raw speaker line: whether it is garbage, its clean form, whether a chair speaks."""
    raw = table(spark, root, "segments").select("raw_name").distinct()
    c = F.col("raw_name")
    return raw.select(c, tx.is_garbage_name(c).alias("garbage"), tx.clean_name(c).alias("clean"), tx.is_chairman(c).alias("chair"))


def person_spellings(spark: SparkSession, root: str) -> DataFrame:
    """Accepted spellings of every person on the roster."""
    m = table(spark, root, "mk_metadata")
    return m.select("person_id", F.explode(tx.spelling_variants(F.col("first_name"), F.col("last_name"), F.col("corpus_full_name"))).alias("variant"))


def _variants(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "mk_name_variants").filter("person_id > 0")
    return v.select("person_id", tx.normalize_text(F.col("variant")).alias("variant")).distinct()


def unique_name_match(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct raw speaker line matched to the one person whose spelling it, or its last words, equal."""
    names = table(spark, root, "segments").select("raw_name").distinct().withColumn("clean", tx.clean_name(F.col("raw_name")))
    return resolve.unique_match(names, "raw_name", "clean", _variants(spark, root), "person_id", "variant").select("raw_name", "person_id", "how")


def name_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Per person: rows whose raw line agrees with the roster's full name, and rows in all."""
    s = table(spark, root, "segments").filter("speaker_id > 0").select("speaker_id", "raw_name")
    m = table(spark, root, "mk_metadata").select(F.col("person_id").alias("speaker_id"), "full_name")
    ok = resolve.tokens_agree(tx.clean_name(F.col("raw_name")), tx.normalize_text(F.col("full_name")))
    return s.join(m, "speaker_id").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("agree"))


def learned_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Names seen for persons on path A, with majority person, purity and usability."""
    s = table(spark, root, "segments").filter("label_path = 'A' AND speaker_id > 0").select(tx.clean_name(F.col("raw_name")).alias("key"), "speaker_id")
    return metrics.majority_key(s, "key", "speaker_id").withColumn("purity", F.round("purity", 9))


def _stints(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "segments").filter("speaker_id > 0 AND knesset IS NOT NULL").select("speaker_id", "knesset", F.col("session_date").try_cast("date").alias("d")).filter("d IS NOT NULL")
    return s.groupBy(F.col("speaker_id").alias("person_id"), "knesset").agg(F.min("d").alias("start"), F.when(F.col("knesset") < 25, F.max("d")).alias("end"))


_STINTS = """
stints AS (
  SELECT speaker_id AS person_id, knesset, min(TRY_CAST(session_date AS DATE)) AS s, CASE WHEN knesset < 25 THEN max(TRY_CAST(session_date AS DATE)) END AS e
  FROM segments WHERE speaker_id > 0 AND knesset IS NOT NULL AND TRY_CAST(session_date AS DATE) IS NOT NULL GROUP BY 1, 2)
"""


def seated_on_date(spark: SparkSession, root: str) -> DataFrame:
    """Per meeting the number of persons whose term covers its date."""
    days = table(spark, root, "manifest").filter("session_date IS NOT NULL").select("session_id", "session_date")
    return resolve.active_on(days, _stints(spark, root), "session_date", "person_id").groupBy("session_id").agg(F.countDistinct("person_id").alias("seated"))


def overlapping_namesakes(spark: SparkSession, root: str) -> DataFrame:
    """Different persons of one spelling, surnames alone among them, whose terms overlap."""
    m = table(spark, root, "mk_metadata").select("person_id", tx.normalize_text(F.col("last_name")).alias("variant")).filter("variant <> ''")
    return resolve.overlapping_homonyms(_variants(spark, root).unionByName(m), _stints(spark, root), "person_id", "variant")


def demoted_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of too long or too short spans demoted; counted by label, reason and whether an id is left."""
    s = table(spark, root, "segments")
    name = tx.span_id(F.lit(0), F.col("session"), F.col("start"), F.col("end"), "wav")
    d = resolve.demote(s, (F.col("duration_s") > 30) | (F.col("duration_s") < 1), "bad_length", ["speaker_name", "gender", "age"], name)
    return d.groupBy("label", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("speaker_id") > 0).alias("with_id"), F.count("speaker_name").alias("named"), F.count_if(F.col("filename").startswith("0_")).alias("zero_names"))


def demographics(spark: SparkSession, root: str) -> DataFrame:
    """Attributes of every speaking person from the roster's current members, else from all of it."""
    m = table(spark, root, "mk_metadata")
    cols = ["gender", "place_of_birth", "religion"]
    who = table(spark, root, "segments").select(F.col("speaker_id").alias("person_id")).filter("person_id > 0").distinct()
    return resolve.attach_demographics(who, m.filter("is_current"), m, "person_id", cols)


def _judged(spark: SparkSession, root: str) -> DataFrame:
    # A gold person who is not on the roster is missing from the corpus.
    known = table(spark, root, "mk_metadata").select(F.col("person_id").alias("__k"), F.col("in_corpus").alias("__in"))
    s = table(spark, root, "segments").join(known, F.col("speaker_id") == F.col("__k"), "left")
    verdict = resolve.judge_holdout(F.col("gold_speaker_id").try_cast("bigint"), F.col("speaker_id"), F.col("label"), F.coalesce("__in", F.lit(False)))
    return s.withColumn("verdict", verdict).withColumn("ms", F.bround(F.coalesce("duration_s", F.lit(0.0)) * 1000).cast("long"))


def holdout_judgement(spark: SparkSession, root: str) -> DataFrame:
    """Assigned ids judged against gold ones: rows and ms by legislature, by method and in all."""
    sets = F.explode(F.array(*[F.struct(F.when(F.lit(k), F.col("knesset")).alias("knesset"), F.when(F.lit(m), F.col("match_method")).alias("method"), F.lit(i).alias("i")) for i, (k, m) in enumerate([(False, False), (True, False), (False, True)])])).alias("x")
    return _judged(spark, root).select("verdict", "ms", sets).groupBy("verdict", "x.knesset", "x.method", "x.i").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms")).drop("i")


def latest_delivery(spark: SparkSession, root: str) -> DataFrame:
    """Per filename the latest delivery with usable times, else the latest one."""
    s = table(spark, root, "segments").filter("filename IS NOT NULL")
    return ledger.latest_success(s, ["filename"], F.col("start").isNotNull() & F.col("end").isNotNull(), "ingested_at", ["speaker_id", "local_speaker_id"]).withColumn("ingested_at", F.unix_micros("ingested_at"))


def speaking_time_shares(spark: SparkSession, root: str) -> DataFrame:
    """Share of each label by rows and by time."""
    s = table(spark, root, "segments").withColumn("ms", tx.to_ms(F.coalesce("duration_s", F.lit(0.0))))
    t = metrics.weighted_shares(s, "label", "ms")
    return t.withColumns({c: F.round(c, 9) for c in ("share_rows", "share_weight")})


def quality_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Speaking time per person that survives each quality threshold."""
    s = table(spark, root, "segments").filter("speaker_id > 0").withColumn("ms", tx.to_ms(F.coalesce("duration_s", F.lit(0.0))))
    return metrics.threshold_sweep(s, ["speaker_id"], "quality", [0.5, 0.7, 0.9, 0.95], "ms")


def quality_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Histogram of quality, by rows and by time."""
    s = table(spark, root, "segments").withColumn("ms", tx.to_ms(F.coalesce("duration_s", F.lit(0.0))))
    return metrics.histogram(s, "quality", 0.0, 1.0, 20, F.col("ms"))


# ---- plans and splits -------------------------------------------------------


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL AND speaker_id > 0 AND session IS NOT NULL")
    one = ledger.latest_success(rows, ["chunk_id"], F.lit(True), "loaded_at", ["speaker_id", "session", "session_date", "duration_s", "quality"])
    return one.withColumn("ms", tx.to_ms(F.col("duration_s")))


_CHUNKS = """
WITH one AS (SELECT chunk_id, arg_max(struct_pack(speaker_id, session, session_date, duration_s, quality), loaded_at) AS v FROM chunk_index WHERE chunk_id IS NOT NULL AND speaker_id > 0 AND session IS NOT NULL GROUP BY 1),
chunks AS (SELECT chunk_id, unnest(v), CAST(round_even(v.duration_s * 1000, 0) AS BIGINT) AS ms FROM one)
"""


def newest_sessions_split(spark: SparkSession, root: str) -> DataFrame:
    """Per speaker the newest meetings to test (1 minute), dev (1 minute) and train."""
    c = splits.session_split(_chunks(spark, root).withColumn("s", F.col("ms") / 1000), "speaker_id", "session", "s", 1.0, 1.0)
    return c.groupBy("speaker_id", "session", "part").agg(F.count(F.lit(1)).alias("chunks"), F.sum("ms").alias("ms"))


def filled_plan(spark: SparkSession, root: str) -> DataFrame:
    """Test, dev and train filled in turn over the newest meetings, each to its target minutes."""
    c = _chunks(spark, root).withColumn("s", F.col("ms") / 1000)
    p = splits.fill_to_targets(c, "speaker_id", [F.desc("session")], "session", "s", [("test", 0.75), ("dev", 0.5), ("train", 2.0)])
    return p.select("speaker_id", "session", "part", F.round(F.col("minutes") * 60000).cast("long").alias("ms"))


def budget_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Order of the training chunks, newest meeting first, with the cumulative ms."""
    c = _chunks(spark, root).withColumn("start", tx.parse_span_id(F.col("chunk_id"))["start_s"])
    o = splits.budget_order(c, "speaker_id", [F.desc("session"), F.asc("start"), F.asc("chunk_id")], "ms")
    return o.select("chunk_id", "speaker_id", F.col("train_order").cast("long").alias("train_order"), F.round(F.col("budget_cum_min") * 60).cast("long").alias("cum_ms"))


def shared_pool(spark: SparkSession, root: str) -> DataFrame:
    """Chunks in turn from every speaker until ten minutes in ms would be exceeded."""
    p = splits.round_robin_pool(_chunks(spark, root), "speaker_id", [F.desc("session"), F.asc("chunk_id")], "ms", 600_000)
    return p.select("chunk_id", "speaker_id", F.col("round").cast("long").alias("round"), "pool_cum")


def speaker_folds(spark: SparkSession, root: str) -> DataFrame:
    """Five folds of the speakers by the order of their hashes."""
    return splits.hash_folds(_chunks(spark, root), "speaker_id", 5, 7)


def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """Two chunks per speaker in the order of their hashes: a stratified sample."""
    return splits.quota_sample(_chunks(spark, root).select("speaker_id", "chunk_id"), "speaker_id", "chunk_id", 2, 3)


def session_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Coverage of the chunk corpus by the plan and by what is usable."""
    c = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(tx.to_ms(F.col("duration_s"))).alias("ms"))
    plan = table(spark, root, "panel_plan_v2")
    ok, bad = (table(spark, root, "chunk_index").filter(f) for f in ("text IS NOT NULL AND text <> ''", "text IS NULL OR text = ''"))
    r = ledger.coverage(c, "chunk_id", F.col("ms"), plan.filter("chunk_id IS NOT NULL"), ok, bad)
    return r.withColumns({k: F.col(k).cast("long") for k in ("subset_hours", "done_hours")})


def key_sets(spark: SparkSession, root: str) -> DataFrame:
    """How the plan's chunks and the index's chunks relate."""
    return ledger.compare_sets(table(spark, root, "panel_plan_v2"), table(spark, root, "chunk_index"), "chunk_id")


def plan_checks(spark: SparkSession, root: str) -> DataFrame:
    """Invariants of the plan, the index and the session list."""
    p, m = table(spark, root, "panel_plan_v2"), table(spark, root, "manifest")
    rows = checks.count_offenders(p, {"positive_duration": F.col("duration_s") > 0, "quality_known": F.col("quality").isNotNull(), "part_known": F.col("part").isNotNull(), "id_parses": tx.parse_span_id(F.col("chunk_id"))["session"].isNotNull()})
    spans = _spans(spark, root)
    return checks.all_checks(
        rows, checks.unique_key(p, ["chunk_id"], "plan_key"), checks.unique_key(m, ["session_id"], "session_key"), checks.disjoint_groups(p.withColumn("t", F.lower(F.trim("part"))), "session", "t", "sessions_apart"),
        checks.monotone_within(spans, ["session"], ["start", "end", "filename"], "end", "ends_in_order"),
    )


# ---- errors, sessions, sets -------------------------------------------------


def top_errors(spark: SparkSession, root: str) -> DataFrame:
    """The fifteen most frequent errors per arm and kind, with near misses and digits marked."""
    e = table(spark, root, "committees_error_content")
    t = metrics.top_counts(e, ["arm", "kind"], "count", ["row_id"], 15)
    return t.select("arm", "kind", "rank", "row_id", "count", tx.has_digit(F.concat_ws(" ", "reference", "hypothesis")).alias("digit"))


def error_arms(spark: SparkSession, root: str) -> DataFrame:
    """Counts of each error side by side for the two arms."""
    e = table(spark, root, "committees_error_content").withColumn("key", F.concat_ws("|", "kind", F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit("")))).groupBy("key", "arm").agg(F.sum("count").alias("n"))
    return metrics.pivot_arms(e, "key", "arm", ["A", "B"], ["n"])


def excess_errors(spark: SparkSession, root: str) -> DataFrame:
    """Errors that arm A has more often in the list than arm B, as multisets."""
    e = table(spark, root, "committees_error_content")
    return ledger.multiset_difference(e.filter("arm = 'A'"), e.filter("arm = 'B'"), ["kind", "reference", "hypothesis"])


def session_routes(spark: SparkSession, root: str) -> DataFrame:
    """Meetings by completeness and route."""
    r = resolve.route_sessions(table(spark, root, "manifest"))
    return r.groupBy("is_complete", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_odata")).alias("in_odata"))


def best_file_kind(spark: SparkSession, root: str) -> DataFrame:
    """Per committee the file kind that is missing least often, and the gap to the next."""
    kinds = ["has_audio", "has_refined", "has_map", "has_speakers", "has_segments", "has_metadata"]
    m = table(spark, root, "manifest").filter("committee_name IS NOT NULL").groupBy("committee_name").agg(*[F.sum(F.when(F.col(k), 0).otherwise(1)).alias(k) for k in kinds])
    b = metrics.best_column(m, "committee_name", kinds)
    return b.select("committee_name", "best", F.col("value").cast("long").alias("missing"), F.col("gap").cast("long").alias("gap"))


def shard_plan(spark: SparkSession, root: str) -> DataFrame:
    """Documents packed in order of id into shards of 100,000 characters."""
    d = table(spark, root, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")).withColumn("chunk", F.floor(F.col("doc_id") / 4096))
    p = ledger.pack_by_size(d, ["doc_id"], "size", 100_000, "chunk")
    return p.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def looping_texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents in which a run of three words occurs three times or more."""
    d = table(spark, root, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("t"))
    return d.select("doc_id", tx.repeats_ngram(F.col("t")).alias("loops")).filter("loops").select("doc_id")


def text_features(spark: SparkSession, root: str) -> DataFrame:
    """Per document: tokens, characters, script and digit tests."""
    d = table(spark, root, "documents")
    t = tx.normalize_text(F.col("text"))
    return d.select("doc_id", tx.token_count(t).cast("long").alias("n_tokens"), F.length(t).cast("long").alias("n_chars"), tx.has_script(F.col("text")).alias("hebrew"), tx.has_digit(F.col("text")).alias("digit"))


def repetitive_texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents that compress to less than a third."""
    d = table(spark, root, "documents").select("doc_id", tx.compression_ratio(F.col("text")).alias("ratio"))
    return d.filter("ratio > 3").select("doc_id", F.round("ratio", 6).alias("ratio"))


def centroid_margins(spark: SparkSession, root: str) -> DataFrame:
    """Per label: vectors that lie nearer to another label's trimmed centroid than to their own."""
    c = resolve.contamination(table(spark, root, "embeddings"), "vec_id", "label", "embedding")
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("margin") < 0).alias("contaminated"))


def control_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Own mean error per (kind, budget) beside the control's of the same budget or of the default one."""
    e = table(spark, root, "committees_error_content").withColumn("budget", F.col("row_id") % 3)
    own = e.filter("arm = 'A'").groupBy("kind", "budget").agg(F.sum("count").alias("own"))
    control = e.filter("arm = 'B'").withColumn("budget", F.col("row_id") % 2).groupBy("kind", "budget").agg(F.sum("count").alias("v"))
    from plenora.operators.decide import with_fallback

    return with_fallback(own, control, ["kind"], "budget", "v", 1).select("kind", "budget", "own", "control")


def job_graph(spark: SparkSession, root: str) -> DataFrame:
    """Ready and dead jobs of a graph with one job per meeting, each waiting for the one of half its rank."""
    from plenora.operators.decide import job_states

    m = table(spark, root, "manifest").select("session_id", "complete").withColumn("chunk", F.floor(F.col("session_id") / 1000))
    from plenora.operators.chunked import running_sum

    r = running_sum(m, [], "chunk", [F.col("session_id")], F.lit(1), "id")
    jobs = r.select(F.col("id").cast("long"), F.when(F.col("id") > 1, F.array(F.floor(F.col("id") / 2).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("deps"), F.when(~F.coalesce("complete", F.lit(True)), "failed").when(F.col("id") % 5 == 0, "done").otherwise("pending").alias("status"))
    return job_states(jobs).select("id", "status", "ready", "dead")


# ---- event time -------------------------------------------------------------


def hourly_events(spark: SparkSession, root: str) -> DataFrame:
    """Events per hour and type (the batch form of the streaming aggregate)."""
    return ingest.tumbling_counts(table(spark, root, "events"), "ts", "1 hour", "10 minutes", ["event_type"])


def user_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each user, events at most two hours apart (the batch form of the streaming operator)."""
    return ingest.activity_sessions(table(spark, root, "events"), "user_id", "ts", "2 hours", "10 minutes").select("user_id", "start", "n")


QUERIES = {
    f.__name__: f
    for f in (
        speaker_turns, merged_speech, turn_windows, session_quality, longest_good_run, midpoints_in_spans, label_ladder, clean_names, person_spellings, unique_name_match, name_agreement, learned_aliases,
        seated_on_date, overlapping_namesakes, demoted_rows, demographics, holdout_judgement, latest_delivery, speaking_time_shares, quality_sweep, quality_histogram, newest_sessions_split, filled_plan,
        budget_prefixes, shared_pool, speaker_folds, stratified_sample, session_coverage, key_sets, plan_checks, top_errors, error_arms, excess_errors, session_routes, best_file_kind, shard_plan,
        looping_texts, text_features, repetitive_texts, centroid_margins, control_fallback, job_graph, hourly_events, user_sessions,
    )
}
_JUDGE = """CASE WHEN sid > 0 AND sid = gid THEN 'correct' WHEN sid > 0 AND gid > 0 THEN 'cross_person' WHEN sid > 0 AND label = 'non_mk' AND inc THEN 'guest_as_mk' WHEN sid > 0 AND label = 'non_mk' THEN 'corpus_missed' WHEN sid > 0 THEN 'unjudged' WHEN gid > 0 THEN 'missed' ELSE 'both_unassigned' END"""
SQL = {
    "speaker_turns": _USABLE + "SELECT session, CAST(turn AS BIGINT) AS turn, speaker_id, count(*) AS n_rows, min(sm) AS start_ms, max(em) AS end_ms FROM turns WHERE speaker_id > 0 GROUP BY ALL",
    "merged_speech": _USABLE + ", r AS (SELECT session, turn, sm, em, filename, max(em) OVER (PARTITION BY session, turn ORDER BY sm, em, filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR sm - reach >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY session, turn ORDER BY sm, em, filename ROWS UNBOUNDED PRECEDING) AS isl FROM r) SELECT session, CAST(turn AS BIGINT) AS turn, min(sm) AS start_ms, max(em) AS end_ms, count(*) AS n_spans FROM i GROUP BY session, turn, isl",
    "longest_good_run": _USABLE.replace("speaker_id, local_speaker_id, CAST", "quality, CAST").split("marked AS")[0].rstrip().rstrip(",").replace("speaker_id DESC NULLS LAST, local_speaker_id DESC NULLS LAST", "quality DESC NULLS LAST") + ", f AS (SELECT *, coalesce(quality >= 0.7, false) AS good, row_number() OVER (PARTITION BY session ORDER BY s, e, filename) - row_number() OVER (PARTITION BY session, coalesce(quality >= 0.7, false) ORDER BY s, e, filename) AS k FROM spans), r AS (SELECT session, k, good, count(*) FILTER (good) AS n FROM f GROUP BY ALL) SELECT session, max(n) AS longest FROM r GROUP BY session",
    "session_quality": _USABLE.replace("speaker_id, local_speaker_id, CAST", "quality, CAST").split("marked AS")[0].rstrip().rstrip(",").replace("speaker_id DESC NULLS LAST, local_speaker_id DESC NULLS LAST", "quality DESC NULLS LAST") + """, v AS (SELECT session, quality AS v, CAST(em - sm AS DOUBLE) AS w, row_number() OVER (PARTITION BY session ORDER BY quality, em - sm, filename) AS i FROM spans WHERE quality IS NOT NULL),
c AS (SELECT *, sum(w) OVER (PARTITION BY session ORDER BY i) - w / 2 AS p, sum(w) OVER (PARTITION BY session) / 2 AS half FROM v),
n AS (SELECT *, lag(v) OVER (PARTITION BY session ORDER BY i) AS pv, lag(p) OVER (PARTITION BY session ORDER BY i) AS pp FROM c)
SELECT session, round(coalesce(min(CASE WHEN p >= half THEN CASE WHEN pv IS NULL THEN v ELSE pv + (v - pv) * (half - pp) / (p - pp) END END), max(v)), 7) AS quality FROM n WHERE p < half OR pp IS NULL OR pp < half GROUP BY session""",
    "midpoints_in_spans": _USABLE + ", pl AS (SELECT DISTINCT chunk_id, session_id AS session, session_offset_s + duration_s / 2 AS mid FROM panel_plan_v2 WHERE session_id IS NOT NULL) SELECT chunk_id, count(*) AS n_spans FROM pl JOIN spans ON pl.session = spans.session AND mid >= s - 0.05 AND mid <= e + 0.05 GROUP BY chunk_id",
    "clean_names": f"SELECT DISTINCT raw_name, {_GARBAGE} AS garbage, {_CLEAN} AS clean, regexp_matches(coalesce(raw_name, ''), '{tx.CHAIR.replace(chr(39), chr(39) * 2)}') AS chair FROM segments",
    "unique_name_match": f"""WITH n AS (SELECT DISTINCT raw_name, {_CLEAN} AS clean FROM segments),
v AS (SELECT DISTINCT person_id AS p, {_NORM.format('variant')} AS variant FROM mk_name_variants WHERE person_id > 0),
t AS (SELECT *, string_split(clean, ' ') AS t FROM n WHERE clean IS NOT NULL),
f AS (SELECT raw_name, 0 AS ix, 'exact' AS how, clean AS form FROM t UNION ALL SELECT raw_name, k - 1, 'suffix', array_to_string(t[-k:], ' ') FROM t CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) WHERE len(t) > k),
h AS (SELECT raw_name, ix, how, count(DISTINCT p) AS n, min(p) AS p FROM f JOIN v ON form = variant GROUP BY ALL),
b AS (SELECT raw_name, arg_min(struct_pack(how, n, p), ix) AS x FROM h GROUP BY raw_name)
SELECT n.raw_name, CASE WHEN x.n = 1 THEN x.p END AS person_id, CASE WHEN x.n = 1 THEN x.how WHEN x.n > 1 THEN 'ambiguous' END AS how FROM n LEFT JOIN b ON n.raw_name = b.raw_name""",
    "name_agreement": f"WITH j AS (SELECT speaker_id, string_split({_CLEAN}, ' ') AS a, list_filter(string_split({_NORM.format('full_name')}, ' '), lambda t: t <> '') AS b FROM segments JOIN (SELECT person_id, full_name FROM mk_metadata) ON speaker_id = person_id WHERE speaker_id > 0) SELECT speaker_id, count(*) AS n, count(*) FILTER (coalesce({_AGREE.format(a='a', b='b')}, false)) AS agree FROM j GROUP BY speaker_id",
    "learned_aliases": f"WITH k AS (SELECT {_CLEAN} AS key, speaker_id FROM segments WHERE label_path = 'A' AND speaker_id > 0), c AS (SELECT key, speaker_id, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS a, row_number() OVER (PARTITION BY key ORDER BY n DESC, speaker_id) AS i FROM c) SELECT key, speaker_id, n, round(n / a, 9) AS purity, n = a AND n >= 3 AS usable FROM r WHERE i = 1",
    "seated_on_date": "WITH " + _STINTS + "SELECT session_id, count(DISTINCT person_id) AS seated FROM manifest JOIN stints ON s <= session_date AND (e IS NULL OR e >= session_date) WHERE session_date IS NOT NULL GROUP BY session_id",
    "overlapping_namesakes": "WITH " + _STINTS + f", v AS (SELECT DISTINCT person_id, {_NORM.format('variant')} AS variant FROM mk_name_variants WHERE person_id > 0 UNION SELECT person_id, {_NORM.format('last_name')} FROM mk_metadata WHERE {_NORM.format('last_name')} <> ''), x AS (SELECT * FROM v JOIN stints USING (person_id)) SELECT DISTINCT a.variant, a.person_id AS a, b.person_id AS b FROM x a JOIN x b ON a.variant = b.variant AND a.person_id < b.person_id AND (a.e IS NULL OR a.e >= b.s) AND (b.e IS NULL OR b.e >= a.s)",
    "label_ladder": f"""WITH j AS (SELECT segments.*, m.pid IS NOT NULL AS known, full_name, is_current, date_of_death, string_split({_CLEAN}, ' ') AS a, list_filter(string_split({_NORM.format('m.full_name')}, ' '), lambda t: t <> '') AS b, {_GARBAGE} AS garbage,
  TRY_CAST(segments.date_of_birth AS DATE) AS born, TRY_CAST(session_date AS DATE) AS d FROM segments LEFT JOIN (SELECT CAST(person_id AS VARCHAR) AS pid, full_name, is_current, date_of_death FROM mk_metadata) m ON gold_speaker_id = m.pid),
k AS (SELECT label_path, label AS given, CASE WHEN coalesce(reason, '') = 'bad_offset' THEN 'unresolved|bad_offset' WHEN gold_speaker_id IS NULL THEN 'unresolved|no_gold' WHEN NOT regexp_full_match(gold_speaker_id, '\\d+') THEN 'non_mk|gold_guest' WHEN garbage THEN 'unresolved|raw_garbage'
  WHEN NOT known THEN 'unresolved|unknown_id' WHEN NOT coalesce({_AGREE.format(a='a', b='b')}, false) THEN 'unresolved|name_disagree' WHEN is_current THEN 'mk|' WHEN date_of_death < d THEN 'unresolved|deceased' WHEN round_even((d - born) / 365.25, 2) > 95 THEN 'unresolved|implausible_age' ELSE 'former_mk|' END AS x FROM j)
SELECT label_path, given, split_part(x, '|', 1) AS label, nullif(split_part(x, '|', 2), '') AS reason, count(*) AS n FROM k GROUP BY ALL""",
    "demoted_rows": "WITH d AS (SELECT *, coalesce(duration_s > 30 OR duration_s < 1, false) AS bad FROM segments) SELECT CASE WHEN bad THEN 'unresolved' ELSE label END AS label, CASE WHEN bad THEN 'bad_length' ELSE reason END AS reason, count(*) AS n, count(*) FILTER (NOT bad AND speaker_id > 0) AS with_id, count(*) FILTER (NOT bad AND speaker_name IS NOT NULL) AS named, count(*) FILTER (CASE WHEN bad THEN true ELSE starts_with(filename, '0_') END) AS zero_names FROM d GROUP BY 1, 2",
    "demographics": "WITH w AS (SELECT DISTINCT speaker_id AS person_id FROM segments WHERE speaker_id > 0) SELECT w.person_id, m.gender, m.place_of_birth, m.religion FROM w LEFT JOIN mk_metadata m ON w.person_id = m.person_id",
    "holdout_judgement": f"WITH j AS (SELECT *, coalesce(speaker_id, 0) AS sid, coalesce(TRY_CAST(gold_speaker_id AS BIGINT), 0) AS gid, coalesce(speaker_id IN (SELECT person_id FROM mk_metadata WHERE in_corpus), false) AS inc FROM segments), v AS (SELECT *, {_JUDGE} AS verdict FROM j) SELECT verdict, knesset, match_method AS method, count(*) AS n, CAST(sum(CAST(round_even(coalesce(duration_s, 0) * 1000, 0) AS BIGINT)) AS BIGINT) AS ms FROM v GROUP BY GROUPING SETS ((verdict), (verdict, knesset), (verdict, match_method))",
    "latest_delivery": 'WITH r AS (SELECT *, "start" IS NOT NULL AND "end" IS NOT NULL AS ok, row_number() OVER (PARTITION BY filename ORDER BY "start" IS NOT NULL AND "end" IS NOT NULL DESC, ingested_at DESC NULLS LAST, speaker_id DESC NULLS LAST, local_speaker_id DESC NULLS LAST) AS k FROM segments WHERE filename IS NOT NULL) SELECT filename, ok, epoch_us(ingested_at) AS ingested_at, speaker_id, local_speaker_id FROM r WHERE k = 1',
    "speaking_time_shares": "WITH g AS (SELECT label, count(*) AS n, sum(CAST(round_even(coalesce(duration_s, 0) * 1000, 0) AS BIGINT)) AS w FROM segments WHERE label IS NOT NULL GROUP BY 1) SELECT label, round(n / sum(n) OVER (), 9) AS share_rows, round(w / sum(w) OVER (), 9) AS share_weight FROM g",
    "quality_sweep": "SELECT speaker_id, threshold, CAST(coalesce(sum(CAST(round_even(coalesce(duration_s, 0) * 1000, 0) AS BIGINT)) FILTER (quality >= threshold), 0) AS BIGINT) AS surviving FROM segments CROSS JOIN (SELECT unnest([0.5, 0.7, 0.9, 0.95])::DOUBLE AS threshold) WHERE speaker_id > 0 GROUP BY ALL",
    "quality_histogram": "SELECT CAST(least(floor(quality / (1.0::DOUBLE / 20)), 19) AS INT) AS bin, count(*) AS n, CAST(sum(CAST(round_even(coalesce(duration_s, 0) * 1000, 0) AS BIGINT)) AS BIGINT) AS weight FROM segments WHERE quality >= 0 AND quality <= 1 GROUP BY 1",
    "newest_sessions_split": _CHUNKS + ", p AS (SELECT speaker_id, session, count(*) AS chunks, sum(ms) AS ms FROM chunks GROUP BY ALL), c AS (SELECT *, sum(ms) OVER w AS c, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY speaker_id ORDER BY session DESC)), t AS (SELECT *, c <= 60000 OR k = 1 AS test FROM c), d AS (SELECT *, sum(ms) OVER w AS c2, row_number() OVER w AS k2 FROM t WINDOW w AS (PARTITION BY speaker_id, test ORDER BY session DESC)) SELECT speaker_id, session, CASE WHEN test THEN 'test' WHEN c2 <= 60000 OR k2 = 1 THEN 'dev' ELSE 'train' END AS part, chunks, CAST(ms AS BIGINT) AS ms FROM d",
    "budget_prefixes": _CHUNKS + ", o AS (SELECT *, CAST(split_part(regexp_extract(chunk_id, '([^/]*)$', 1), '_', 3) AS BIGINT) AS st FROM chunks) SELECT chunk_id, speaker_id, row_number() OVER w - 1 AS train_order, CAST(sum(ms) OVER w AS BIGINT) AS cum_ms FROM o WINDOW w AS (PARTITION BY speaker_id ORDER BY session DESC, st, chunk_id ROWS UNBOUNDED PRECEDING)",
    "shared_pool": _CHUNKS + ", q AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY session DESC, chunk_id) - 1 AS round FROM chunks), c AS (SELECT *, sum(ms) OVER (ORDER BY round, speaker_id ROWS UNBOUNDED PRECEDING) AS pool_cum FROM q) SELECT chunk_id, speaker_id, round, CAST(pool_cum AS BIGINT) AS pool_cum FROM c WHERE pool_cum <= 600000",
    "speaker_folds": _CHUNKS + ", k AS (SELECT DISTINCT speaker_id FROM chunks) SELECT speaker_id, CAST((row_number() OVER (ORDER BY md5('7|' || speaker_id), speaker_id) - 1) % 5 AS INT) AS fold FROM k",
    "stratified_sample": _CHUNKS + ", r AS (SELECT speaker_id, chunk_id, row_number() OVER (PARTITION BY speaker_id ORDER BY md5('3|' || chunk_id), chunk_id) AS k FROM chunks) SELECT speaker_id, chunk_id FROM r WHERE k <= 2",
    "session_coverage": "WITH c AS (SELECT chunk_id, max(CAST(round_even(duration_s * 1000, 0) AS BIGINT)) AS ms, bool_or(text IS NOT NULL AND text <> '') AS done, bool_or(text IS NULL OR text = '') AS failed FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY 1), m AS (SELECT *, chunk_id IN (SELECT chunk_id FROM panel_plan_v2 WHERE chunk_id IS NOT NULL) AS s FROM c) SELECT count(*) AS chunks, count(*) FILTER (s) AS subset_chunks, count(*) FILTER (s AND done) AS subset_done, count(*) FILTER (s AND NOT done) AS subset_pending, count(*) FILTER (NOT s AND done) AS extra_done, CAST(coalesce(sum(ms) FILTER (s), 0) AS BIGINT) AS subset_hours, CAST(coalesce(sum(ms) FILTER (s AND done), 0) AS BIGINT) AS done_hours, count(*) FILTER (failed AND NOT done) AS pending_errors FROM m",
    "key_sets": "WITH a AS (SELECT DISTINCT chunk_id FROM panel_plan_v2 WHERE chunk_id IS NOT NULL), b AS (SELECT DISTINCT chunk_id FROM chunk_index WHERE chunk_id IS NOT NULL), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (chunk_id)) AS n_both) SELECT *, n_a - n_both AS only_a, n_b - n_both AS only_b, n_a = n_both AND n_b = n_both AS equal, n_both = 0 AS disjoint, n_a = n_both AS a_in_b FROM n",
    "plan_checks": _USABLE + """, c AS (
SELECT 'positive_duration' AS "check", count(*) FILTER (NOT coalesce(duration_s > 0, false)) AS offenders FROM panel_plan_v2 UNION ALL SELECT 'quality_known', count(*) FILTER (quality IS NULL) FROM panel_plan_v2 UNION ALL SELECT 'part_known', count(*) FILTER (part IS NULL) FROM panel_plan_v2
UNION ALL SELECT 'id_parses', count(*) FILTER (NOT coalesce(regexp_matches(chunk_id, '(^|/)-?\\d+_\\d+_\\d+_\\d+\\.\\w+$'), false)) FROM panel_plan_v2
UNION ALL SELECT 'plan_key', count(*) FROM (SELECT chunk_id FROM panel_plan_v2 GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'session_key', count(*) FROM (SELECT session_id FROM manifest GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'sessions_apart', count(*) FROM (SELECT session FROM panel_plan_v2 WHERE session IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(part))) > 1)
UNION ALL SELECT 'ends_in_order', count(*) FROM (SELECT e < lag(e) OVER (PARTITION BY session ORDER BY s, e, filename) AS bad FROM spans) WHERE bad) SELECT *, offenders = 0 AS ok FROM c""",
    "top_errors": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY arm, kind ORDER BY count DESC, row_id) AS rank FROM committees_error_content) SELECT arm, kind, CAST(rank AS INT) AS rank, row_id, count, regexp_matches(concat_ws(' ', reference, hypothesis), '\\p{Nd}') AS digit FROM r WHERE rank <= 15",
    "error_arms": "WITH e AS (SELECT concat_ws('|', kind, coalesce(reference, ''), coalesce(hypothesis, '')) AS key, arm, sum(count) AS n FROM committees_error_content GROUP BY ALL) SELECT key, CAST(max(n) FILTER (arm = 'A') AS BIGINT) AS n_A, CAST(max(n) FILTER (arm = 'B') AS BIGINT) AS n_B, coalesce(bool_or(arm = 'A'), false) AS has_A, coalesce(bool_or(arm = 'B'), false) AS has_B FROM e GROUP BY key",
    "excess_errors": "SELECT kind, reference, hypothesis, count(*) AS n FROM (SELECT kind, reference, hypothesis FROM committees_error_content WHERE arm = 'A' EXCEPT ALL SELECT kind, reference, hypothesis FROM committees_error_content WHERE arm = 'B') GROUP BY ALL",
    "session_routes": "WITH r AS (SELECT *, coalesce(has_audio, false) AND coalesce(has_refined, false) AND coalesce(has_map, false) AND coalesce(has_speakers, false) AND coalesce(has_segments, false) AND coalesce(has_metadata, false) AS is_complete FROM manifest) SELECT is_complete, CASE WHEN is_complete AND coalesce(has_shard, false) THEN 'A' WHEN is_complete THEN 'B' ELSE '' END AS path, count(*) AS n, count(*) FILTER (in_odata) AS in_odata FROM r GROUP BY 1, 2",
    "best_file_kind": "WITH l AS (SELECT committee_name, i, k, count(*) FILTER (NOT coalesce(v, false)) AS m FROM (SELECT committee_name, unnest([{'i': 0, 'k': 'has_audio', 'v': has_audio}, {'i': 1, 'k': 'has_refined', 'v': has_refined}, {'i': 2, 'k': 'has_map', 'v': has_map}, {'i': 3, 'k': 'has_speakers', 'v': has_speakers}, {'i': 4, 'k': 'has_segments', 'v': has_segments}, {'i': 5, 'k': 'has_metadata', 'v': has_metadata}], recursive := true) FROM manifest WHERE committee_name IS NOT NULL) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY committee_name ORDER BY m, i) AS n FROM l) SELECT committee_name, max(k) FILTER (n = 1) AS best, max(m) FILTER (n = 1) AS missing, max(m) FILTER (n = 2) - max(m) FILTER (n = 1) AS gap FROM r GROUP BY 1",
    "shard_plan": """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, coalesce(length(text), 0)::BIGINT AS size FROM documents),
f AS (SELECT i, size, 0::BIGINT AS shard, size AS pending FROM d WHERE i = 1 UNION ALL
  SELECT d.i, d.size, CASE WHEN f.pending >= 100000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.pending >= 100000 THEN d.size ELSE f.pending + d.size END FROM f JOIN d ON d.i = f.i + 1)
SELECT shard, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY shard""",
    "looping_texts": f"WITH t AS (SELECT doc_id, list_filter(string_split({_NORM.format('text')}, ' '), lambda t: t <> '') AS t FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM t WHERE len(t) >= 3) SELECT DISTINCT doc_id FROM (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) >= 3)",
    "centroid_margins": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
u AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), cu AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c),
s AS (SELECT vec_id, u.label, sum(x * m) AS cos FROM u JOIN cu ON u.label = cu.label AND u.i = cu.i GROUP BY ALL),
k AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) WHERE r <= greatest(round_even(n * 0.75, 0), 1)),
c2 AS (SELECT u.label, i, avg(x) AS m FROM u JOIN k USING (vec_id) GROUP BY ALL), cu2 AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c2),
a AS (SELECT vec_id, u.label, cu2.label AS l2, sum(x * m) AS cos FROM u JOIN cu2 ON u.i = cu2.i GROUP BY ALL),
m AS (SELECT vec_id, label, max(cos) FILTER (label = l2) - max(cos) FILTER (label <> l2) AS margin FROM a GROUP BY ALL)
SELECT label, count(*) AS n, count(*) FILTER (margin < 0) AS contaminated FROM m GROUP BY label""",
    "control_fallback": "WITH o AS (SELECT kind, row_id % 3 AS budget, CAST(sum(count) AS BIGINT) AS own FROM committees_error_content WHERE arm = 'A' GROUP BY ALL), c AS (SELECT kind, row_id % 2 AS budget, CAST(sum(count) AS BIGINT) AS v FROM committees_error_content WHERE arm = 'B' GROUP BY ALL) SELECT o.kind, o.budget, own, CASE WHEN o.budget IN (SELECT budget FROM c WHERE v IS NOT NULL) THEN s.v ELSE d.v END AS control FROM o LEFT JOIN c s ON o.kind = s.kind AND o.budget = s.budget LEFT JOIN c d ON o.kind = d.kind AND d.budget = 1",
    "job_graph": "WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY session_id) AS id, complete FROM manifest), j AS (SELECT id, id // 2 AS dep, CASE WHEN NOT coalesce(complete, true) THEN 'failed' WHEN id % 5 = 0 THEN 'done' ELSE 'pending' END AS status FROM m), dead AS (SELECT j.id FROM j JOIN j p ON j.dep = p.id WHERE p.status = 'failed' UNION SELECT j.id FROM j JOIN dead ON j.dep = dead.id) SELECT j.id, j.status, j.status = 'pending' AND coalesce(p.status = 'done', j.dep = 0) AS ready, j.status = 'pending' AND j.id IN (SELECT id FROM dead) AS dead FROM j LEFT JOIN j p ON j.dep = p.id",
    "text_features": f"WITH t AS (SELECT doc_id, text, {_NORM.format('text')} AS t FROM documents) SELECT doc_id, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n_tokens, length(t) AS n_chars, coalesce(regexp_matches(text, '[א-ת]'), false) AS hebrew, coalesce(regexp_matches(text, '\\p{{Nd}}'), false) AS digit FROM t",
    "filled_plan": _CHUNKS + """, q AS (SELECT speaker_id, session, CAST(sum(ms) AS BIGINT) AS ms FROM chunks GROUP BY 1, 2), p AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY speaker_id ORDER BY session DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM q),
a AS (SELECT *, cum - ms < 45000 AS t FROM p), b AS (SELECT *, coalesce(max(cum) FILTER (t) OVER (PARTITION BY speaker_id), 0) AS b1 FROM a),
c AS (SELECT *, NOT t AND cum - ms - b1 < 30000 AS d FROM b), e AS (SELECT *, coalesce(max(cum) FILTER (t OR d) OVER (PARTITION BY speaker_id), 0) AS b2 FROM c)
SELECT speaker_id, session, CASE WHEN t THEN 'test' WHEN d THEN 'dev' WHEN cum - ms - b2 < 120000 THEN 'train' END AS part, ms FROM e""",
    "person_spellings": f"""WITH n AS (SELECT person_id, string_split(trim(regexp_replace(concat_ws(' ', first_name, last_name), '\\s+', ' ', 'g')), ' ') AS p, string_split(trim(regexp_replace(concat_ws(' ', last_name, first_name), '\\s+', ' ', 'g')), ' ') AS w, string_split(trim(regexp_replace(coalesce(corpus_full_name, ''), '\\s+', ' ', 'g')), ' ') AS f FROM mk_metadata),
x AS (SELECT person_id, unnest([array_to_string(p, ' '), array_to_string(w, ' '), array_to_string(list_reverse(p), ' '), array_to_string(f, ' '), array_to_string(list_reverse(f), ' ')]) AS v FROM n) SELECT DISTINCT person_id, {_NORM.format('v')} AS variant FROM x WHERE {_NORM.format('v')} <> ''""",
    "turn_windows": _USABLE.replace("WITH latest", "WITH RECURSIVE latest") + """, o AS (SELECT session, turn, s, e, row_number() OVER (PARTITION BY session, turn ORDER BY s, e) AS i FROM turns WHERE speaker_id > 0),
f AS (SELECT session, turn, i, e, CASE WHEN e - s > 30 THEN NULL ELSE s END AS seek, CASE WHEN e - s > 30 THEN NULL ELSE e END AS last, CASE WHEN e - s > 30 THEN 0 ELSE 1 END AS no, e - s <= 30 AS took FROM o WHERE i = 1
  UNION ALL SELECT o.session, o.turn, o.i, o.e, CASE WHEN o.e - o.s > 30 THEN NULL WHEN f.seek IS NOT NULL AND o.e <= f.seek + 30 THEN f.seek WHEN f.seek IS NOT NULL AND o.e <= f.last + 30 AND o.s >= f.last THEN f.last ELSE o.s END,
    CASE WHEN o.e - o.s > 30 THEN NULL WHEN f.seek IS NOT NULL AND o.e <= f.seek + 30 THEN greatest(o.e, f.last) ELSE o.e END, CASE WHEN o.e - o.s > 30 OR (f.seek IS NOT NULL AND o.e <= f.seek + 30) THEN f.no ELSE f.no + 1 END, o.e - o.s <= 30
  FROM f JOIN o ON f.session = o.session AND f.turn = o.turn AND o.i = f.i + 1)
SELECT session, CAST(turn AS BIGINT) AS turn, no AS "window", CAST(round_even(min(seek) * 1000, 0) AS BIGINT) AS seek_ms, CAST(round_even(max(e) * 1000, 0) AS BIGINT) AS end_ms, count(*) AS n_spans FROM f WHERE took GROUP BY ALL""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "user_sessions": "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
}
