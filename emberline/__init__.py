"""Spark-native emerging-topic analytics."""
