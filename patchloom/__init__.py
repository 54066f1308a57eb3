"""Spark-native retrieval, patch checking and evaluation analytics over collections of text and source files."""
