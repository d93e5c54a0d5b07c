"""Structured Streaming forms of the trace operators."""
