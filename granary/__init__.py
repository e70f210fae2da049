"""Granary: corpus preparation and analytics on Spark DataFrames."""
