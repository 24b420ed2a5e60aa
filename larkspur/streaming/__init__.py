"""Structured Streaming forms of the counters, limits and alerts."""
