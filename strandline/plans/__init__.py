"""The graph query language: text to syntax tree to one Spark plan."""
