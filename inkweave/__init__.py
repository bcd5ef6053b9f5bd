"""inkweave: a PySpark-native engine for editorial, workflow and transcript records."""

__version__ = "0.1.0"
