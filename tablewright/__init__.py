"""Understand, check and model tables with Spark: DataFrames in, DataFrames out."""
