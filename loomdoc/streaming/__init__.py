"""Structured Streaming over change logs."""
