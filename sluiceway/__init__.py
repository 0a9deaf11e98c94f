"""Exposure governance and decision auditing on Spark DataFrames."""

__version__ = "0.1.0"
