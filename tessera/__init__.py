"""Spark-native code-intelligence analytics: DataFrame-first operators over symbol tables."""
