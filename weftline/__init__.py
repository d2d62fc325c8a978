"""Weftline: Spark-native analytics for time-resolved networks."""
