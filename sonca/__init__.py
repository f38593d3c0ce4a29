"""Spark-native Vietnamese corpus analytics."""
