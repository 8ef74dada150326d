"""Spark-native preparation, parsing and scoring of text-to-code data."""
