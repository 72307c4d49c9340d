"""Spark-native expression, event-state and corpus engine."""
