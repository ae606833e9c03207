"""Spark-native engine for reviewed document-layout datasets."""
