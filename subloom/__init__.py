"""Timed-text analytics on Spark."""

__version__ = "0.1.0"
