"""Spark-native anomaly analytics for device and network telemetry."""
