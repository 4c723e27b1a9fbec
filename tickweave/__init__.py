"""Tick-level time-series analytics on PySpark."""
