"""Spark-native engine for systematic-strategy research on bar data."""
