"""Structured Streaming front end of the index."""
