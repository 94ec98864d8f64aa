"""Warehouse movement telemetry analytics on Spark DataFrames."""
