"""Structured Streaming forms of loading and task state."""
