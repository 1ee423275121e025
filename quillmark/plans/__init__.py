"""Queries over the driver's tables and their DuckDB counterparts."""

from quillmark.plans import analysis_queries, corpus_queries, extended_queries, image_queries, metric_queries  # noqa: F401
from quillmark.plans.registry import ORACLES as ALL_ORACLES
from quillmark.plans.registry import QUERIES as ALL_QUERIES

__all__ = ["ALL_ORACLES", "ALL_QUERIES"]
