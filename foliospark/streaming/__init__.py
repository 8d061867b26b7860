"""Structured Streaming forms of the monitoring reads."""
