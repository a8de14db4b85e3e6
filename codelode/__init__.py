"""codelode: analytics over source-code chunks, their graph, findings and text, planned by Spark."""

__version__ = "0.1.0"
