"""Spark-native hybrid text retrieval."""
