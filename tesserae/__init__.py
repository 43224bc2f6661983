"""Spark-native retrieval and grounded-answer analytics, batched over many queries."""

__version__ = "0.1.0"
