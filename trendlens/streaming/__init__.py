"""Structured Streaming variants of the batch jobs."""

from trendlens.streaming.rollup import compact, read_rollup, start_rollup_stream, vacuum

__all__ = ["compact", "read_rollup", "start_rollup_stream", "vacuum"]
