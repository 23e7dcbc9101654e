"""Spark-native knowledge-graph analytics: statements in DataFrames, patterns lowered to joins."""

__version__ = "0.1.0"
