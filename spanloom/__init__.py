"""Spark-native analytics over agent execution traces."""
