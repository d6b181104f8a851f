"""Spark-native tiled image analytics."""

__version__ = "0.1.0"
