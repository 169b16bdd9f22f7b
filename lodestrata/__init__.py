"""Spark-native retrieval, governance and analytics over document collections."""
