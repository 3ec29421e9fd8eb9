"""Spark-native analytics for text-pair scorers and step-level reward signals."""
