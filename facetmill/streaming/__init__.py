"""Structured Streaming ingest (an extension, not a parity item)."""
