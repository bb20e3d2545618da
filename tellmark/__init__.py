"""Spark-native habit analytics over round-based match telemetry and star-schema tables."""
