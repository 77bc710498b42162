"""Spark-native analytics for market-style event, quote and bar data."""

__version__ = "0.1.0"
