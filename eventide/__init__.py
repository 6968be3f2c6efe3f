"""Spark-first operators for timestamped event tapes."""
