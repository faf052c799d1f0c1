"""Spark-native entity resolution, evidence scoring and corpus preparation."""

__version__ = "0.1.0"
