"""Structured Streaming variants (error counts, sliding averages, stateful alerts)."""
