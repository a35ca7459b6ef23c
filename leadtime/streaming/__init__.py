"""Streaming entry points."""

from .score_stream import compact_sink, read_quarantine, read_scored, score_stream  # noqa: F401
