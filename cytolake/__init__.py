"""Spark-native single-cell methylation analytics."""

__version__ = "0.1.0"
