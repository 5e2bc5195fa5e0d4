"""Spark-native analysis of text corpora and source repositories."""
