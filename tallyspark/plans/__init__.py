"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL over the same parquet tables."""

from .registry import QUERIES, ORACLE, register  # noqa: F401
from . import catalog  # noqa: F401  (registers everything)
