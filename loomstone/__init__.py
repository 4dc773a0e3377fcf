"""Spark-native multi-model analytics: see README.md."""
