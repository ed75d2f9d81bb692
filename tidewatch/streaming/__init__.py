"""Structured Streaming jobs over log lines."""
