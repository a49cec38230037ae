"""Spark-native analytics for single-cell sequencing tables."""
