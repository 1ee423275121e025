"""Spark-native corpus and score analytics."""
