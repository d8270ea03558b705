"""Structured Streaming: the path of hook events."""
