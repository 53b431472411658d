"""Spark-native hybrid search over code and documents."""
