"""Spark-native analytics over linked text corpora."""

__version__ = "0.1.0"
