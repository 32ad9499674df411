"""Spark-native analytics over area-by-day surveillance panels and feature tables."""
