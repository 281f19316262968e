"""Structured Streaming forms of ingestion, cleaning and dedupe."""
