"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.llm.canon import canonical, look_alike_pairs, look_alike_rows
from plenora.llm.groupsplit import assign_splits, label_profiles, parted_groups, plan_rows
from plenora.llm.leakage import leaks
from plenora.llm.names import attribute, learn_lexicon, linked_pairs
from plenora.llm.packing import pack, token_counts
from plenora.llm.sampling import consistent_sample
from plenora.llm.truncation import truncated
from plenora.llm.turns import collapse_runs
from plenora.operators.segments import usable_spans
from plenora.session import written
from plenora.sources.tables import table


def _entities(spark: SparkSession, root: str) -> DataFrame:
    variants, roster = table(spark, root, "mk_name_variants"), table(spark, root, "mk_metadata")
    return attribute(variants, "variant_id", "variant", "person_id", "n_seen", learn_lexicon(variants, "variant", roster))


def p1_entities(spark: SparkSession, root: str) -> DataFrame:
    """The entity of every spelling that can be read as a name."""
    return _entities(spark, root).select(F.col("row").alias("variant_id"), F.col("person").alias("person_id"), "entity")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of rows that name the same person, at least one of them unresolved."""
    return linked_pairs(_entities(spark, root)).select(F.col("a").alias("variant_id_a"), F.col("b").alias("variant_id_b"))


def p2_turns(spark: SparkSession, root: str) -> DataFrame:
    """Every turn, single rows included, with row count, talk and elapsed time in ms."""
    spans = usable_spans(table(spark, root, "segments"), ["speaker_id", "local_speaker_id"])
    runs = collapse_runs(spans)
    ms = lambda c: F.round(c * 1000).cast("long")
    return runs.select("session", "first_filename", "last_filename", "n_rows", ms(F.col("end") - F.col("start")).alias("elapsed_ms"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Turns of at least two rows."""
    return p2_turns(spark, root).filter("n_rows >= 2").select("session", "first_filename", "last_filename", "n_rows")


#: Tokens in a training sequence.
CAPACITY = 2048


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place in a training sequence of CAPACITY tokens."""
    docs = table(spark, root, "documents")
    return pack(token_counts(docs, "doc_id", "text"), "doc_id", CAPACITY, total=docs.count())


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item."""
    return leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "benchmark"), "item_id", "text")


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Every benchmark item with the number of documents that leak it."""
    per = p8_found(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, root, "benchmark").select("item_id", "lang").join(per, "item_id", "left").select("item_id", "lang", F.coalesce("n", F.lit(0)).alias("n_documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, root, "documents"), "doc_id", "text", "source").filter("cut").select("doc_id")


def p9_sources(spark: SparkSession, root: str) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    rows = truncated(table(spark, root, "documents"), "doc_id", "text", "source")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut"))


_P2 = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC NULLS LAST, session DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST, speaker_id DESC NULLS LAST, local_speaker_id DESC NULLS LAST) AS rn
  FROM segments WHERE filename IS NOT NULL),
spans AS (
  SELECT session, filename, "start" AS s, "end" AS e, coalesce(speaker_id, 0) AS sid, local_speaker_id AS voice
  FROM latest WHERE rn = 1 AND session IS NOT NULL AND "end" > "start" AND NOT isnan("start") AND NOT isnan("end")),
lagged AS (
  SELECT *, lag(sid) OVER w AS psid, lag(voice) OVER w AS pvoice, row_number() OVER w AS i
  FROM spans WINDOW w AS (PARTITION BY session ORDER BY s, e, filename)),
flagged AS (
  SELECT *, CASE WHEN i = 1 THEN 1 WHEN sid > 0 AND psid > 0 THEN CAST(sid <> psid AS INT)
                 WHEN voice IS NOT NULL AND pvoice IS NOT NULL AND voice = pvoice THEN 0 ELSE 1 END AS opens FROM lagged),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY s, e, filename ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
turns AS (
  SELECT session, run, arg_min(filename, i) AS first_filename, arg_max(filename, i) AS last_filename, count(*) AS n_rows,
         CAST(round((max(e) - min(s)) * 1000) AS BIGINT) AS elapsed_ms
  FROM runs GROUP BY session, run)
"""

#: Expected members per speaker while a speaker has more chunks than that.
SAMPLE_TARGET = 20.0
#: Wanted shares of the rows.
SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def p3_sample(spark: SparkSession, root: str) -> DataFrame:
    """Sample of chunks by speaker that keeps its members from batch to batch."""
    rows = table(spark, root, "chunk_index").select("chunk_id", "speaker_id", "batch")
    return consistent_sample(rows, "chunk_id", "speaker_id", "batch", SAMPLE_TARGET)[0]


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    return assign_splits(plan_rows(table(spark, root, "panel_plan_v2")), SHARES)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Meetings and persons whose rows stand in more than one part of the given plan."""
    return parted_groups(written(_assigned(spark, root))).select("group_kind", "group_id")


def p4_splits(spark: SparkSession, root: str) -> DataFrame:
    """A new split of every row of the plan in which no meeting or person parts."""
    return _assigned(spark, root).select("chunk_id", "meeting", "speaker", "part", "split")


def p4_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the new splits: every row placed once, no group parted, no quota missed by more than the largest component."""
    rows = written(_assigned(spark, root))
    parted = label_profiles(rows, F.countDistinct("split").alias("n_splits")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_splits") > 1).alias("n_parted"))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.first("split").alias("split"))
    loads = sizes.agg(F.sum("n").alias("n_rows"), F.max("n").alias("largest"), *[F.coalesce(F.sum(F.when(F.col("split") == p, F.col("n"))), F.lit(0)).alias(p) for p in SHARES])
    near = F.lit(True)
    for p, share in SHARES.items():
        near = near & (F.abs(F.col(p) - F.col("n_rows") * share) <= F.col("largest"))
    return loads.crossJoin(parted).select("n_rows", "n_groups", "n_parted", (F.col("n_rows") - sum((F.col(p) for p in SHARES), F.lit(0))).alias("n_unplaced"), near.alias("near_quota"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Substitutions whose sides look the same, and chunks that look like another chunk's different text."""
    err = table(spark, root, "committees_error_content").filter("kind = 'substitution'")
    pairs = look_alike_pairs(err, "reference", "hypothesis").select(F.lit("committees_error_content").alias("src"), F.col("row_id").cast("string").alias("rec_key"))
    chunks = look_alike_rows(table(spark, root, "chunk_index"), "chunk_id", "text")
    return pairs.distinct().unionByName(chunks.select(F.lit("chunk_index").alias("src"), F.col("id").alias("rec_key")))


def p6_forms(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of every chunk's text, and its case-folded form for comparison."""
    rows = table(spark, root, "chunk_index").select("chunk_id", "batch", "text")
    return rows.select("chunk_id", "batch", canonical(F.col("text")).alias("form"), canonical(F.col("text"), fold_case=True).alias("folded"))


_P3 = """
WITH firsts AS (
  SELECT chunk_id, min({'b': batch, 's': coalesce(speaker_id, -9)}) AS f FROM chunk_index WHERE chunk_id IS NOT NULL AND batch IS NOT NULL GROUP BY chunk_id),
seen AS (SELECT chunk_id, f.b AS first_batch, f.s AS s, CAST(('0x' || substr(md5('sample|' || chunk_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS h FROM firsts),
new AS (SELECT s, first_batch, count(*) AS n FROM seen GROUP BY ALL),
weights AS (SELECT s, first_batch, least(1.0::DOUBLE, 20.0::DOUBLE / sum(n) OVER (PARTITION BY s ORDER BY first_batch)) AS weight FROM new)
SELECT chunk_id, CASE WHEN s <> -9 THEN s END AS speaker_id, first_batch, weight FROM seen JOIN weights USING (s, first_batch) WHERE h < weight
"""

_P4 = """
WITH rows_ AS (
  SELECT TRY_CAST(nullif(regexp_extract(session, '_\\s*([0-9]+)\\s*$', 1), '') AS BIGINT) AS meeting, CASE WHEN speaker_id > 0 THEN speaker_id END AS speaker, lower(trim(part)) AS p FROM panel_plan_v2),
named AS (
  SELECT *, CASE WHEN p LIKE 'tr%' THEN 'train' WHEN p LIKE 'dev%' OR p LIKE 'val%' THEN 'dev' WHEN p LIKE 'te%' THEN 'test' END AS part FROM rows_)
"""

QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_turns": p2_turns, "p3_sample": p3_sample, "p4_found": p4_found, "p4_splits": p4_splits, "p4_checks": p4_checks, "p6_found": p6_found, "p6_forms": p6_forms, "p7_packed": p7_packed, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_sources": p9_sources}
SQL = {
    "p2_found": _P2 + "SELECT session, first_filename, last_filename, n_rows FROM turns WHERE n_rows >= 2",
    "p2_turns": _P2 + "SELECT session, first_filename, last_filename, n_rows, elapsed_ms FROM turns",
    "p3_sample": _P3,
    "p4_found": _P4 + """SELECT 'session' AS group_kind, meeting AS group_id FROM named WHERE meeting IS NOT NULL GROUP BY meeting HAVING count(DISTINCT part) > 1
UNION ALL SELECT 'speaker', speaker FROM named WHERE speaker IS NOT NULL GROUP BY speaker HAVING count(DISTINCT part) > 1""",
    "p4_checks": _P4 + "SELECT count(*) AS n_rows, count(DISTINCT meeting) + count(DISTINCT speaker) AS n_groups, 0 AS n_parted, 0 AS n_unplaced, true AS near_quota FROM named",
}
