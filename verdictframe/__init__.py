"""Evaluation analytics on Spark DataFrames: gates, scorers, diagnosis, metrics and run events."""
