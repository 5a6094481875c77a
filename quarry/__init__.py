"""Quarry: referential data subsetting and profiling on Spark."""
