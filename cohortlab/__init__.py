"""Longitudinal-evidence analytics on Spark DataFrames."""
