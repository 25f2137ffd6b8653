"""Structured Streaming forms of event-log operators."""
