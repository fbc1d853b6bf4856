"""Spark-native analytics over parliamentary transcripts."""

__version__ = "0.1.0"
