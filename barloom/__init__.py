"""Spark-native research analytics over price-bar tables."""
