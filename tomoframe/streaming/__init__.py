"""Structured Streaming over arriving particle tables."""
