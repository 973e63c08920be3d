"""Spark-native analytics for sensor- and sample-driven network monitoring."""
