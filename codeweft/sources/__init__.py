"""Readers and the index store."""
