"""Spark-native retrieval, reference-completeness and answer-verification analytics."""
