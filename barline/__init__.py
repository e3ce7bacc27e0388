"""Barline: market-time-series analytics as PySpark jobs."""
