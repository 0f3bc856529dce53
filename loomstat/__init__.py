"""Experiment and market analytics on Spark DataFrames."""
