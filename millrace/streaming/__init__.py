"""Structured Streaming forms of the event operators."""

from millrace.streaming.events import follow_visits, hourly_counts, into_batches, run_once, user_visits, without_repeats

__all__ = ["follow_visits", "hourly_counts", "into_batches", "run_once", "user_visits", "without_repeats"]
