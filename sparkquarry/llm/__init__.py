"""Operators of a training-data pipeline: tokenising, filters, deduplication, scoring, packing and formatting."""
