"""Every query the engine offers over the standard tables, with its SQL twin."""

from __future__ import annotations

from posemill.plans import analysis, learned, parsing, pipeline, readers, selection, twins  # noqa: F401
from posemill.plans.registry import QUERIES, SQL


flagship = analysis.screening_report


def queries() -> dict:
    return QUERIES | parsing.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | parsing.SQL
