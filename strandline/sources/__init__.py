"""Readers and writers of the graph's tables."""
