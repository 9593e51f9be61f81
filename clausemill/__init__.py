"""Spark-native structuring, retrieval and analytics for clause-numbered document libraries."""
