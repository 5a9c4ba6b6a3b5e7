"""Operators over nodes, edges, files and lines; all return DataFrames."""
