"""Structured Streaming: indexing files as they come."""
