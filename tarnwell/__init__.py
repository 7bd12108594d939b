"""Spark-native time-series, text-dataset and evidence analytics."""
