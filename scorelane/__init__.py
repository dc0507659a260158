"""Spark-native evaluation of closed-choice decisions at scale."""

__version__ = "0.2.0"
