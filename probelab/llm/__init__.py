"""Operators of a training-data pipeline, each on Spark DataFrames."""
