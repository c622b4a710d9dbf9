"""Bulk-synchronous analytics on Spark DataFrames."""
