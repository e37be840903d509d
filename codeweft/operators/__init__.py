"""Distributed operators: search, duplicates, call graph, index upkeep, ranking."""
