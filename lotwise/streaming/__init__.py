"""Structured Streaming pipelines over event feeds."""
