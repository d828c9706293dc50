"""Spark-native auditing of text corpora that feed retrieval systems."""
