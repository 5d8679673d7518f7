"""Driving-log analytics on Spark: every operator takes and returns DataFrames."""
