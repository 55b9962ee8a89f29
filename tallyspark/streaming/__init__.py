"""Structured Streaming variants of the ingest and spend paths."""

from .ingest import read_month_spend, stream_import, stream_month_spend  # noqa: F401
