"""Structured Streaming forms of the lifecycle operators."""
