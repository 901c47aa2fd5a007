"""Ordered-stream analytics on Spark."""
