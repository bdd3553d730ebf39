"""Spark-native analytics over the logical tables of a content-addressed store."""
