"""Spark-native analytics for one-dimensional sensor traces and event tables."""
