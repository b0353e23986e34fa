"""Spark-native engine for turning raw web pages and feeds into structured, searchable news metadata."""
