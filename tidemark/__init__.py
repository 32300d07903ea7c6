"""Spark-native analytics for coordinated-account detection in social interaction data."""
