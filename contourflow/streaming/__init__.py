"""Structured Streaming forms of the status logs."""
