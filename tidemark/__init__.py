"""Spark-native point-in-time analytics."""
