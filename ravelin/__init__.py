"""Parallel MapReduce and bulk-synchronous analytics over typed tables, on Spark DataFrames."""
