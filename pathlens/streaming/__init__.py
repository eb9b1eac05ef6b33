"""Structured Streaming jobs: live totals, sliding windows, enrichment, sinks."""
