"""Retail price analytics as Spark jobs over DataFrames."""
