"""Spark-native conversation-memory analytics and training-data operators."""
