"""Spark-native engine for code-evidence analytics."""
