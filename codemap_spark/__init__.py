"""Spark-native architecture-fact engine."""

__version__ = "0.2.0"
