"""Spark-native analytics over timed, multi-speaker text."""

__version__ = "0.1.0"
