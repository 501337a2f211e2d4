"""Spark-native knowledge curation and retrieval engine."""

__version__ = "0.1.0"
