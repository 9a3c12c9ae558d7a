"""Structured Streaming: resumable ingestion, running totals and deduplication."""
