"""Continuous refresh with Structured Streaming."""

from tidemark.streaming.refresh import stream_refresh
from tidemark.streaming.state import stream_state

__all__ = ["stream_refresh", "stream_state"]
