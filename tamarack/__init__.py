"""Spark-native engine for building and scoring structured-extraction datasets."""
