"""Spark-native engine for evaluating evidence-compression experiments."""
