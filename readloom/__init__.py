"""Spark-native transcript tagging and training-corpus processing."""

__version__ = "0.1.0"
