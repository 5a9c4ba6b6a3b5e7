"""Incremental upkeep: micro-batches of file changes, their journal, and windows over events."""
