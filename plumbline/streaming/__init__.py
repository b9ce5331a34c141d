"""Structured Streaming: ingest of source lines, and windowed counts."""
