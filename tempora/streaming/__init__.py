"""Structured Streaming forms of the checks and the shift."""
