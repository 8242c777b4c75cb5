"""Keyed, time-aware event analytics on Spark DataFrames."""
