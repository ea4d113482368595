"""Spark-native engine for activation-based retrieval and analytics over vector graphs."""
