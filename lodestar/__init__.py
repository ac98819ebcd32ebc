"""Spark-first architecture analytics."""
