"""Structured Streaming pipelines over the event log."""
