"""Queries that validate runs, tables and labels, name-only labelling, and reports.

The tables hold no run log; ``_runs`` makes one of the scored chunks: two arms
with a model each, an error where the reference has fewer than three words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.functions import text as tx
from plenora.functions.align import char_distance
from plenora.operators import resolve, select, validate
from plenora.plans.corpus import _CLEAN, _GARBAGE, _JUDGE, _NORM, _STINTS, _judged, _stints, _variants
from plenora.plans.scoring import SCORED, scored_chunks
from plenora.session import written
from plenora.sources.tables import table


def _runs(spark: SparkSession, root: str) -> DataFrame:
    s = scored_chunks(spark, root)
    arms = F.explode(F.array(F.struct(F.lit("A").alias("arm"), F.lit("m1").alias("model"), F.col("hyp_a").alias("hypothesis")), F.struct(F.lit("B").alias("arm"), F.lit("m2").alias("model"), F.col("hyp_b").alias("hypothesis")))).alias("x")
    rows = s.select("chunk_id", F.col("ref").alias("reference"), "words", "duration_s", "speaker_id", arms).select("*", "x.*").drop("x")
    return rows.withColumn("error", F.when(F.col("words") < 3, "timeout"))


_RUNS = SCORED + """, runs AS (
  SELECT s.chunk_id, ref AS reference, words, duration_s, speaker_id, x.arm, x.model, x.hypothesis, CASE WHEN words < 3 THEN 'timeout' END AS error
  FROM (SELECT s.*, a.ha, a.hb FROM scored s JOIN (SELECT chunk_id, array_to_string(a, ' ') AS ha, array_to_string(b, ' ') AS hb FROM arms) a USING (chunk_id)) s,
       LATERAL (SELECT unnest([{'arm': 'A', 'model': 'm1', 'hypothesis': ha}, {'arm': 'B', 'model': 'm2', 'hypothesis': hb}]) AS x))
"""


def run_verification(spark: SparkSession, root: str) -> DataFrame:
    """Whether a run is complete and sound: errors, keys, empty texts, script, references, arms, models."""
    expected = table(spark, root, "chunk_index").filter("text IS NOT NULL AND text <> '' AND chunk_id IS NOT NULL")
    return validate.run_checks(written(_runs(spark, root)), "chunk_id", "arm", ["A", "B"], expected)


def final_validation(spark: SparkSession, root: str) -> DataFrame:
    """Offenders of every final check of the runs against the index."""
    index = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by("speaker_id", "loaded_at").alias("speaker_id"), F.max("duration_s").alias("duration_s"))
    scores = F.abs(F.size(tx.tokens(F.col("hypothesis"))) - F.col("words")) <= F.col("words")
    return validate.final_checks(written(_runs(spark, root)), index, "chunk_id", "arm", ["speaker_id"], {"duration_s": 0.01}, scores)


def corpus_constants(spark: SparkSession, root: str) -> DataFrame:
    """Constants of the roster and session tables beside what a revision had."""
    m = table(spark, root, "mk_metadata")
    return validate.pinned(m, {"least_id": (F.min("person_id"), 0), "genders": (F.countDistinct("gender"), 2), "nameless": (F.count_if(F.col("full_name").isNull()), 0)})


def name_tables_equal(spark: SparkSession, root: str) -> DataFrame:
    """Whether resolved spellings and the roster's full names hold the same (person, name) rows."""
    v = table(spark, root, "mk_name_variants").filter("origin = 'roster'").select("person_id", tx.normalize_text(F.col("variant")).alias("name"))
    return validate.same_tables(v, table(spark, root, "mk_metadata").select("person_id", tx.normalize_text(F.col("full_name")).alias("name")))


def file_settings(spark: SparkSession, root: str) -> DataFrame:
    """Which flags have the same value in every session of the manifest."""
    return validate.settings_equal(table(spark, root, "manifest"), ["has_audio", "has_refined", "has_map", "has_speakers", "complete", "in_odata"])


def label_quality(spark: SparkSession, root: str) -> DataFrame:
    """Precision, recall and error of the assigned ids by speaking time: in all, by legislature, by method."""
    t = validate.precision_recall(_judged(spark, root), "verdict", "ms", {"knesset": "knesset", "method": "match_method"})
    return t.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "error")})


def known_wrong_labels(spark: SparkSession, root: str) -> DataFrame:
    """Assignments in which the gold id names another person: none may be made again."""
    s = table(spark, root, "segments")
    known = s.filter("gold_speaker_id RLIKE '^[0-9]+$' AND speaker_id > 0").filter(F.col("gold_speaker_id").try_cast("bigint") != F.col("speaker_id")).select("session", "speaker_id", "raw_name")
    return validate.known_errors(s.filter("label IN ('mk', 'former_mk')"), known, ["session", "speaker_id", "raw_name"])


def centroid_gate(spark: SparkSession, root: str) -> DataFrame:
    """Gate over the plan's rows: a low quality is a flag; parts of the sessions decide."""
    p = table(spark, root, "panel_plan_v2").withColumn("p", F.lower(F.trim("part")))
    g = validate.gate_verdict(p, F.col("quality") < 0.72, "p", "session")
    return g.select(F.round("share", 9).alias("share"), F.size("sessions").alias("n_sessions"), F.array_join("sessions", "|").alias("sessions"), "passed")


def failure_reconciliation(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of the manifest after a second pass: without segments an error, incomplete ones transient and retried."""
    m = table(spark, root, "manifest").select("session_id", F.when(~F.coalesce("complete", F.lit(False)), F.when(F.col("session_id") % 2 == 0, "HTTP 503").otherwise("bad file")).alias("error"))
    rows = table(spark, root, "segments").select(F.col("session").alias("session_id")).filter("session_id IS NOT NULL")
    retried = m.select("session_id", F.when(F.col("session_id") % 3 == 0, "connection reset by peer").alias("error"))
    return validate.reconcile_failures(m, rows, retried, "session_id")


def number_summary(spark: SparkSession, root: str) -> DataFrame:
    """Count, mean, spread and exact quartiles of the chunks' numbers."""
    return validate.describe(table(spark, root, "chunk_index"), ["duration_s", "quality", "n_words", "age"])


def labels_by_path(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each label path by label, 0 where none."""
    return validate.cross_table(table(spark, root, "segments"), "label_path", "label", ["mk", "former_mk", "non_mk", "unresolved"])


def minutes_by_part(spark: SparkSession, root: str) -> DataFrame:
    """Milliseconds of each speaker's rows by part of the plan."""
    p = table(spark, root, "panel_plan_v2").withColumn("p", F.lower(F.trim("part")))
    return validate.cross_table(p, "speaker_id", "p", ["train", "dev", "test"], tx.to_ms(F.col("duration_s")))


def methods_of_names(spark: SparkSession, root: str) -> DataFrame:
    """Every speaker's match methods, joined in order."""
    return validate.label_sets(table(spark, root, "segments").filter("speaker_id > 0"), "speaker_id", "match_method")


def text_report(spark: SparkSession, root: str) -> DataFrame:
    """Several aggregates as one report of JSON lines."""
    s = table(spark, root, "segments")
    return validate.report(("labels", s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))), ("sessions", s.agg(F.countDistinct("session").alias("n"))))


def _named(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "segments").filter("session_date IS NOT NULL").select("raw_name", F.col("session_date").try_cast("date").alias("d"), "reason", "et_id")
    return s.withColumn("clean", tx.clean_name(F.col("raw_name")))


def seated_name_match(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (name line, date) pairs matched to the one person seated that day whose spelling equals."""
    names = _named(spark, root).select("raw_name", "d", "clean").distinct()
    m = resolve.seated_match(names, "clean", "d", _variants(spark, root), "person_id", "variant", written(_stints(spark, root)))
    return m.select("raw_name", F.col("d").cast("string").alias("d"), "person_id", "how")


def name_only_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels and reasons by name alone: a unique match among those seated, else a usable alias of someone seated, minus the editors' vetoes; rows counted."""
    rows, stints = _named(spark, root), written(_stints(spark, root))
    m = resolve.seated_match(rows, "clean", "d", _variants(spark, root), "person_id", "variant", stints)
    from plenora.operators.metrics import majority_key

    pairs = table(spark, root, "segments").filter("label_path = 'A' AND speaker_id > 0").select(tx.clean_name(F.col("raw_name")).alias("clean"), "speaker_id")
    alias = majority_key(pairs, "clean", "speaker_id").select(F.col("clean").alias("a_c"), F.col("speaker_id").alias("a_p"), "usable")
    terms = stints.select(F.col("person_id").alias("a_p"), F.col("start").alias("a_s"), F.col("end").alias("a_e"))
    seated = m.select("d").distinct().join(terms, (F.col("a_s") <= F.col("d")) & (F.col("a_e").isNull() | (F.col("a_e") >= F.col("d")))).select(F.col("d").alias("t_d"), "a_p", F.lit(True).alias("alias_seated")).distinct()
    j = m.join(alias, F.col("clean") == F.col("a_c"), "left").join(seated, (F.col("t_d") == F.col("d")) & (alias["a_p"] == seated["a_p"]), "left")
    matched = F.coalesce(F.col("person_id"), F.when(F.coalesce("usable", F.lit(False)) & F.coalesce("alias_seated", F.lit(False)), alias["a_p"]))
    x = resolve.label_by_name(F.coalesce(F.col("reason"), F.lit("")) != "bad_offset", tx.is_garbage_name(F.col("raw_name")), F.col("how"), F.col("usable"), F.col("alias_seated"), F.col("et_id").isNotNull() & matched.isNotNull() & (F.col("et_id") != matched))
    return j.withColumn("x", x).groupBy(F.col("x.label").alias("label"), F.col("x.reason").alias("reason"), F.coalesce("how", F.lit("none")).alias("how")).agg(F.count(F.lit(1)).alias("n"))


def near_miss_shares(spark: SparkSession, root: str) -> DataFrame:
    """Per arm, weighted by count: substitutions one character apart, errors with a digit, and all errors."""
    e = table(spark, root, "committees_error_content")
    both = F.col("kind") == "substitution"
    d = char_distance(F.col("reference"), F.col("hypothesis"))
    digit = tx.has_digit(F.concat_ws(" ", "reference", "hypothesis"))
    s = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias(n)
    return e.groupBy("arm").agg(s(both, "substitutions"), s(both & (d == 1), "near"), s(digit, "with_digit"), s(F.lit(True), "errors"))


def guarded_texts(spark: SparkSession, root: str) -> DataFrame:
    """Committee and length of every planned chunk's text, late and wide columns joined on a key proven unique."""
    plan = table(spark, root, "panel_plan_v2").filter("chunk_id IS NOT NULL").select("chunk_id").distinct()
    wide = table(spark, root, "chunk_index").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "committee_name", "text")).alias("x")).select("chunk_id", "x.committee_name", "x.text")
    return select.attach_wide(plan, wide, "chunk_id", ["committee_name", "text"]).select("chunk_id", "committee_name", F.length("text").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        run_verification, final_validation, corpus_constants, name_tables_equal, file_settings, label_quality, known_wrong_labels, centroid_gate, failure_reconciliation, number_summary, labels_by_path,
        minutes_by_part, methods_of_names, text_report, seated_name_match, name_only_labels, near_miss_shares, guarded_texts,
    )
}
_MS = "CAST(round_even(coalesce(duration_s, 0) * 1000, 0) AS BIGINT)"
_FORMS = f"""names AS (SELECT DISTINCT raw_name, TRY_CAST(session_date AS DATE) AS d, {_CLEAN} AS clean FROM segments WHERE session_date IS NOT NULL),
v AS (SELECT DISTINCT person_id AS p, {_NORM.format('variant')} AS variant FROM mk_name_variants WHERE person_id > 0),
t AS (SELECT DISTINCT clean, d, string_split(clean, ' ') AS t FROM names WHERE clean IS NOT NULL AND d IS NOT NULL),
f AS (SELECT clean, d, 0 AS ix, 'exact' AS how, clean AS form FROM t UNION ALL SELECT clean, d, k - 1, 'suffix', array_to_string(t[-k:], ' ') FROM t CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) WHERE len(t) > k),
h AS (SELECT clean, d, ix, how, count(DISTINCT p) AS n, min(p) AS p FROM f JOIN v ON form = variant JOIN stints ON person_id = p AND s <= d AND (e IS NULL OR e >= d) GROUP BY ALL),
b AS (SELECT clean, d, arg_min(struct_pack(how, n, p), ix) AS x FROM h GROUP BY ALL),
matched AS (SELECT clean, d, CASE WHEN x.n = 1 THEN x.p END AS person_id, CASE WHEN x.n = 1 THEN x.how ELSE 'ambiguous' END AS how FROM b)
"""
SQL = {
    "run_verification": _RUNS + """, k AS (SELECT chunk_id, max(n) AS most, count(*) AS arms FROM (SELECT chunk_id, arm, count(*) AS n FROM runs GROUP BY ALL) GROUP BY chunk_id),
x AS (SELECT DISTINCT chunk_id FROM chunk_index WHERE text IS NOT NULL AND text <> '' AND chunk_id IS NOT NULL)
SELECT count(*) FILTER (error IS NOT NULL) = 0 AS no_errors, count(*) FILTER (trim(coalesce(hypothesis, '')) = '') = 0 AS not_empty, avg(regexp_matches(hypothesis, '[א-ת]')::INT) >= 0.5 AS script, count(*) FILTER (trim(coalesce(reference, '')) = '') = 0 AS references,
 (SELECT max(most) <= 1 FROM k) AS unique, (SELECT count(*) = 0 FROM k FULL JOIN x ON k.chunk_id = x.chunk_id WHERE k.chunk_id IS NULL OR x.chunk_id IS NULL) AS same_keys, (SELECT bool_and(arms = 2) FROM k) AS paired, true AS different_models FROM runs""",
    "final_validation": _RUNS + """, idx AS (SELECT chunk_id, arg_max(speaker_id, loaded_at) AS speaker_id, max(duration_s) AS duration_s FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
j AS (SELECT r.*, i.speaker_id AS i_s, i.duration_s AS i_d, i.chunk_id AS i_k, len(list_filter(string_split(hypothesis, ' '), lambda t: t <> '')) AS hw, len(list_filter(string_split(reference, ' '), lambda t: t <> '')) AS rw FROM runs r LEFT JOIN idx i ON r.chunk_id = i.chunk_id),
c AS (SELECT 'coverage' AS "check", count(*) AS offenders FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM runs)
UNION ALL SELECT 'pending', count(*) FROM (SELECT chunk_id FROM runs GROUP BY chunk_id HAVING NOT bool_or(error IS NULL))
UNION ALL SELECT 'one_row', count(*) FROM (SELECT chunk_id, arm FROM runs GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'foreign', count(*) FILTER (i_k IS NULL) FROM j UNION ALL SELECT 'differs_speaker_id', count(*) FILTER (i_k IS NOT NULL AND speaker_id IS DISTINCT FROM i_s) FROM j
UNION ALL SELECT 'differs_duration_s', count(*) FILTER (i_k IS NOT NULL AND NOT coalesce(abs(duration_s - i_d) < 0.01, false)) FROM j UNION ALL SELECT 'empty', count(*) FILTER (trim(coalesce(hypothesis, '')) = '') FROM j
UNION ALL SELECT 'leak', count(*) FILTER (rw >= 16 AND reference = hypothesis) FROM j UNION ALL SELECT 'scores', count(*) FILTER (NOT abs(hw - words) <= words) FROM j) SELECT *, offenders = 0 AS ok FROM c""",
    "corpus_constants": """SELECT *, found IS NOT DISTINCT FROM pinned AS ok FROM (SELECT 'least_id' AS constant, CAST(min(person_id) AS VARCHAR) AS found, '0' AS pinned FROM mk_metadata UNION ALL SELECT 'genders', CAST(count(DISTINCT gender) AS VARCHAR), '2' FROM mk_metadata
UNION ALL SELECT 'nameless', CAST(count(*) FILTER (full_name IS NULL) AS VARCHAR), '0' FROM mk_metadata)""",
    "name_tables_equal": f"WITH a AS (SELECT person_id, {_NORM.format('variant')} AS name FROM mk_name_variants WHERE origin = 'roster'), b AS (SELECT person_id, {_NORM.format('full_name')} AS name FROM mk_metadata), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM c",
    "file_settings": "SELECT *, n_values <= 1 AS ok FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS setting, count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) AS n_values FROM manifest" for c in ("has_audio", "has_refined", "has_map", "has_speakers", "complete", "in_odata")) + ")",
    "label_quality": f"""WITH j AS (SELECT *, coalesce(speaker_id, 0) AS sid, coalesce(TRY_CAST(gold_speaker_id AS BIGINT), 0) AS gid, coalesce(speaker_id IN (SELECT person_id FROM mk_metadata WHERE in_corpus), false) AS inc, {_MS} AS ms FROM segments), v AS (SELECT *, {_JUDGE} AS verdict FROM j),
l AS (SELECT verdict, ms, 'ALL' AS level, '' AS value FROM v UNION ALL SELECT verdict, ms, 'knesset', coalesce(CAST(knesset AS VARCHAR), '') FROM v UNION ALL SELECT verdict, ms, 'method', coalesce(match_method, '') FROM v),
g AS (SELECT level, value, coalesce(sum(ms) FILTER (verdict = 'correct'), 0) AS correct, coalesce(sum(ms) FILTER (verdict IN ('cross_person', 'guest_as_mk')), 0) AS wrong, coalesce(sum(ms) FILTER (verdict IN ('cross_person', 'missed')), 0) AS lost FROM l GROUP BY ALL)
SELECT level, value, correct::BIGINT AS correct, wrong::BIGINT AS wrong, lost::BIGINT AS lost, round(correct / nullif(correct + wrong, 0), 9) AS precision, round(correct / nullif(correct + lost, 0), 9) AS recall, round(wrong / nullif(correct + wrong, 0), 9) AS error FROM g""",
    "known_wrong_labels": "WITH k AS (SELECT DISTINCT session, speaker_id, raw_name FROM segments WHERE regexp_full_match(gold_speaker_id, '[0-9]+') AND speaker_id > 0 AND TRY_CAST(gold_speaker_id AS BIGINT) <> speaker_id), c AS (SELECT count(*) AS n FROM segments s JOIN k ON s.session = k.session AND s.speaker_id = k.speaker_id AND s.raw_name = k.raw_name WHERE label IN ('mk', 'former_mk')) SELECT 'known_errors' AS \"check\", n AS offenders, n = 0 AS ok FROM c",
    "centroid_gate": "WITH f AS (SELECT coalesce(quality < 0.72, false) AS f, lower(trim(part)) AS p, session FROM panel_plan_v2), s AS (SELECT DISTINCT session FROM f WHERE f AND p IN ('test', 'dev') AND session IS NOT NULL), a AS (SELECT round(avg(f::INT), 9) AS share, (SELECT count(*) FROM s) AS n_sessions, (SELECT coalesce(string_agg(session, '|' ORDER BY session), '') FROM s) AS sessions FROM f) SELECT *, share <= 0.10 AND n_sessions = 0 AS passed FROM a",
    "failure_reconciliation": """WITH m AS (SELECT session_id, CASE WHEN NOT coalesce(complete, false) THEN CASE WHEN session_id % 2 = 0 THEN 'HTTP 503' ELSE 'bad file' END END AS error FROM manifest),
k AS (SELECT session_id, CASE WHEN error IS NULL AND session_id NOT IN (SELECT session FROM segments WHERE session IS NOT NULL) THEN 'no rows' ELSE error END AS error FROM m),
r AS (SELECT session_id, CASE WHEN error = 'HTTP 503' THEN CASE WHEN session_id % 3 = 0 THEN 'connection reset by peer' END ELSE error END AS error FROM k) SELECT *, coalesce(error IN ('HTTP 503', 'connection reset by peer'), false) AS retry FROM r""",
    "number_summary": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM chunk_index" for c in ("duration_s", "quality", "n_words", "age")),
    "labels_by_path": "SELECT label_path, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in ("mk", "former_mk", "non_mk", "unresolved")) + " FROM segments WHERE label_path IS NOT NULL GROUP BY 1",
    "minutes_by_part": "SELECT speaker_id, " + ", ".join(f"CAST(coalesce(sum(CAST(round_even(duration_s * 1000, 0) AS BIGINT)) FILTER (lower(trim(part)) = '{x}'), 0) AS BIGINT) AS {x}" for x in ("train", "dev", "test")) + " FROM panel_plan_v2 WHERE speaker_id IS NOT NULL GROUP BY 1",
    "methods_of_names": "SELECT speaker_id, coalesce(string_agg(match_method, '|' ORDER BY match_method), '') AS labels, count(match_method) AS n_labels FROM (SELECT DISTINCT speaker_id, match_method FROM segments WHERE speaker_id > 0) GROUP BY 1",
    "seated_name_match": "WITH " + _STINTS + ", " + _FORMS + "SELECT raw_name, CAST(n.d AS VARCHAR) AS d, person_id, how FROM names n LEFT JOIN matched m ON n.clean = m.clean AND n.d = m.d",
    "name_only_labels": "WITH " + _STINTS + ", " + _FORMS + f""", k AS (SELECT {_CLEAN} AS key, speaker_id FROM segments WHERE label_path = 'A' AND speaker_id > 0), c AS (SELECT key, speaker_id, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL),
al AS (SELECT key, arg_min(speaker_id, struct_pack(a := -n, b := speaker_id)) AS ap, max(n) = sum(n) AND max(n) >= 3 AS usable FROM c GROUP BY key),
j AS (SELECT s.*, {_GARBAGE} AS garbage, m.person_id, m.how, al.ap, coalesce(usable AND EXISTS (SELECT 1 FROM stints WHERE stints.person_id = ap AND stints.s <= s.d AND (stints.e IS NULL OR stints.e >= s.d)), false) AS by_alias
  FROM (SELECT raw_name, TRY_CAST(session_date AS DATE) AS d, reason AS given, et_id, {_CLEAN} AS clean FROM segments WHERE session_date IS NOT NULL) s LEFT JOIN matched m ON s.clean = m.clean AND s.d = m.d LEFT JOIN al ON s.clean = al.key),
x AS (SELECT coalesce(how, 'none') AS how, CASE WHEN coalesce(given, '') = 'bad_offset' THEN 'bad_offset' WHEN garbage THEN 'raw_garbage' WHEN how = 'ambiguous' THEN 'ambiguous' WHEN how IS NULL AND NOT by_alias THEN 'no_match'
  WHEN et_id IS NOT NULL AND et_id <> coalesce(person_id, CASE WHEN by_alias THEN ap END) THEN 'et_conflict' END AS reason FROM j) SELECT CASE WHEN reason IS NULL THEN 'mk' ELSE 'unresolved' END AS label, reason, how, count(*) AS n FROM x GROUP BY ALL""",
    "guarded_texts": "WITH w AS (SELECT chunk_id, arg_max(struct_pack(committee_name, text), loaded_at) AS x FROM chunk_index WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT p.chunk_id, x.committee_name AS committee_name, length(x.text) AS n_chars FROM (SELECT DISTINCT chunk_id FROM panel_plan_v2 WHERE chunk_id IS NOT NULL) p LEFT JOIN w ON p.chunk_id = w.chunk_id",
    "near_miss_shares": """WITH v AS (SELECT *, string_split(reference, '') AS r, string_split(hypothesis, '') AS h, list_distinct(list_concat(string_split(coalesce(reference, ''), ''), string_split(coalesce(hypothesis, ''), ''))) AS v FROM committees_error_content),
d AS (SELECT *, levenshtein(list_aggregate(list_transform(r, lambda c: chr(CAST(32 + list_position(v, c) AS INT))), 'string_agg', ''), list_aggregate(list_transform(h, lambda c: chr(CAST(32 + list_position(v, c) AS INT))), 'string_agg', '')) AS d FROM v)
SELECT arm, CAST(coalesce(sum(count) FILTER (kind = 'substitution'), 0) AS BIGINT) AS substitutions, CAST(coalesce(sum(count) FILTER (kind = 'substitution' AND d = 1), 0) AS BIGINT) AS near, CAST(coalesce(sum(count) FILTER (regexp_matches(concat_ws(' ', reference, hypothesis), '\\p{Nd}')), 0) AS BIGINT) AS with_digit, CAST(sum(count) AS BIGINT) AS errors FROM d GROUP BY arm""",
    "text_report": """SELECT 'labels' AS section, '{' || coalesce('"label":"' || label || '",', '') || '"n":' || count(*) || '}' AS line FROM segments GROUP BY label UNION ALL SELECT 'sessions', '{"n":' || count(DISTINCT session) || '}' FROM segments""",
}
