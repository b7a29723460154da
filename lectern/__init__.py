"""Timed-text analytics on PySpark DataFrames."""
