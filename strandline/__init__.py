"""strandline: property-graph, code-intelligence and text analytics as Spark plans."""

__version__ = "0.1.0"
