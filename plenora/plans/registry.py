"""All named queries of the core library, gathered from the plan modules."""

from __future__ import annotations

from plenora.plans import corpus, intervals, panel, runs, scoring, validation

MODULES = [scoring, corpus, runs, intervals, validation, panel]
FLAGSHIP = "per_speaker_error_map"


def queries() -> dict:
    """name -> callable(spark, folder)."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> SQL."""
    return {k: s for m in MODULES for k, s in m.SQL.items()}
