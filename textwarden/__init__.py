"""Sensitive-text analytics for Spark: find, judge, report and mask personal
data and leaked secrets in tables and streams of text."""

__version__ = "0.1.0"
