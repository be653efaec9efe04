"""Transforms from DataFrames to DataFrames."""
