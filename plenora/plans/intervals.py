"""Queries on overlapping and gapped intervals (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenora.operators.intervals import periods_and_gaps
from plenora.operators.segments import usable_spans
from plenora.sources.tables import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Speech periods of every session and the gaps between them, in ms."""
    spans = usable_spans(table(spark, root, "segments"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return periods_and_gaps(spans, ["session"], ms("start"), ms("end")).select("session", "kind", "start_ms", "end_ms")


P5_SQL = """
WITH latest AS (
  SELECT filename, session, "start" AS s, "end" AS e,
         row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC NULLS LAST, session DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST) AS rn
  FROM segments WHERE filename IS NOT NULL),
spans AS (
  SELECT session, CAST(round(s * 1000) AS BIGINT) AS s, CAST(round(e * 1000) AS BIGINT) AS e
  FROM latest WHERE rn = 1 AND session IS NOT NULL AND e > s AND NOT isnan(s) AND NOT isnan(e)),
reached AS (
  SELECT *, max(e) OVER (PARTITION BY session ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM spans WHERE s < e),
marked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM reached),
periods AS (SELECT session, island, min(s) AS s, max(e) AS e FROM marked GROUP BY session, island),
nexts AS (SELECT *, lead(s) OVER (PARTITION BY session ORDER BY s) AS after FROM periods)
SELECT session, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL
SELECT session, 'gap' AS kind, e AS start_ms, after AS end_ms FROM nexts WHERE after IS NOT NULL
"""

QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": P5_SQL}
