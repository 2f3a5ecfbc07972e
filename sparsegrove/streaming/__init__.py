"""Streaming forms of the operators: the same rules on unbounded inputs, with watermarks that bound the state of all but running numbers."""

from .streams import distinct_texts, expiring_gap_groups, gap_sessions, index_stream, running_gap_groups, window_counts

__all__ = ["distinct_texts", "expiring_gap_groups", "gap_sessions", "index_stream", "running_gap_groups", "window_counts"]
