"""Sector-level vulnerability statistics on Spark DataFrames."""
