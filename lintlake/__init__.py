"""Spark-native analytics over static-analysis evidence."""
