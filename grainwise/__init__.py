"""Metrics over rows and jobs over definitions, as Spark DataFrames."""
