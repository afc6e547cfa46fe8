"""Structured Streaming forms of the rate and trigger operators; the batch queries use the same expressions."""
