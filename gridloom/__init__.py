"""Gridded ensemble analytics on Spark."""
