"""Spark-native document analytics: chunking, hybrid retrieval, grounded answers."""

__version__ = "0.1.0"
