"""Operators over facts: snapshots, diffs, traversal, impact, documentation, chunks, retrieval, activation."""
