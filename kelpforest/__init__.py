"""Spark-native retrieval, chunking and memory engine."""

__version__ = "0.1.0"
