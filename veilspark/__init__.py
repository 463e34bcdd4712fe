"""Spark-native detection, reversible masking and audit analytics for text at table scale."""
