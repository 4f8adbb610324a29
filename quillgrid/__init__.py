"""Spark-native engine for code-review benchmark results and preference-training data."""
