"""Spark-native similarity search, duplicate detection and evaluation over feature catalogues."""
