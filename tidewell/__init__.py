"""Spark-native retrieval, plan analytics and metadata queries."""
