"""Behavioral drift analytics on Spark: DataFrames in, findings, scores and alerts out."""
