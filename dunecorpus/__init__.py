"""Spark-native analytics for large corpora of short, noisy, multi-script text."""
