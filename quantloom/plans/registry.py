"""All registered queries of the library, with their DuckDB twins."""

from __future__ import annotations

from . import evaluation_queries, file_queries, grading_queries, learning_queries, linking_queries, market_queries, model_queries, panel_queries, report_queries, series_queries, snapshot_queries, stream_queries, study_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
