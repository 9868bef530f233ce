"""Structured Streaming: arriving files and arriving fingerprints."""
