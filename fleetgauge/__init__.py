"""Metrics of a fleet of big-data clusters, computed with Spark DataFrames."""
