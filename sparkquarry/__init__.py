"""Spark-native corpus and code analytics: files, lines, tokens, tree rows and findings as DataFrames."""

__version__ = "0.1.0"
