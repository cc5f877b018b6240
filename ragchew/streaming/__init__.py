"""Incremental ingest with Structured Streaming (same operators as batch)."""

from ragchew.streaming.spots import stream_spot_ingest  # noqa: F401
