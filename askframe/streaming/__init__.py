"""Structured Streaming jobs on status feeds."""
